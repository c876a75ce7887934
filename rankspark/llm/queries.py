"""The registered queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.llm import decontam, hostrules, mixing, quality, runs, sharding, simhash, suffix, tokencounts, topk, toxicity, turntrie, urls
from rankspark.session import pin, scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontam.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), ["doc_id"])
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                         F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: The rules of the contract, as (host, path, action).
RULES = [urls.Rule("com", "/en/", "block"), urls.Rule("example.com", "/en/7", "allow"), urls.Rule("net", "/de/", "allow"),
         urls.Rule("example.net", "/de/8", "block"), urls.Rule("org", "/es/", "block")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(read(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches, the second sent twice: all documents come in, counted by white space and by a byte-pair vocabulary; of equal texts
    all but the smallest id go; the white-space counts of what is left are revised to counts of words."""
    docs = read(spark, sf_dir, "documents").withColumn("tokens", F.coalesce(F.regexp_count("text", F.lit(mixing.TOKEN)), F.lit(0)).cast("long"))
    counted = tokencounts.byte_pair_counts(tokencounts.word_counts(docs, name="revised"), name="pairs")
    counts = pin(counted.select("doc_id", "source", "lang", "tokens", "revised", "pairs", F.md5(F.coalesce("text", F.lit(""))).alias("digest")), "counts")
    by_space, by_pairs = F.struct(F.lit("words").alias("version"), "tokens"), F.struct(F.lit("byte_bpe_50k").alias("version"), F.col("pairs").alias("tokens"))
    both = [F.inline(F.array(by_space, by_pairs))]
    first = counts.groupBy("digest").agg(F.min("doc_id").alias("first"))
    copies = counts.join(first, "digest").withColumn("copy", F.col("doc_id") > F.col("first"))
    rollup = tokencounts.Rollup(spark, scratch_path(spark, "totals"))
    rollup.apply("load", tokencounts.inserts(counts.select("source", "lang", *both)))
    for _ in range(2):
        rollup.apply("copies", tokencounts.deletes(copies.where("copy").select("source", "lang", *both)))
    rollup.apply("words", tokencounts.revisions(copies.where("not copy").withColumn("version", F.lit("words"))))
    return rollup.totals().select("source", "lang", "version", "documents", "tokens")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(mixing.mix(read(spark, sf_dir, "documents"), ["doc_id"]), ["doc_id"])


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(read(spark, sf_dir, "documents"), 24, ["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix.remove_repeats(read(spark, sf_dir, "documents"), ["doc_id"])
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_products(vectors, vectors.where("vec_id % 50 = 0"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth document (by the hash of its id) gets a periodic end first."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("h", F.crc32(F.col("doc_id").cast("string"))).withColumn("g", F.floor(F.col("h") / 10))
    planted = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(mixing.TOKEN), F.lit(0)))
    docs = docs.withColumn("w", planted).withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    period = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))
    docs = docs.withColumn("p", F.when(F.col("n") > 0, period))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    rewritten = F.array_join(F.transform("w", lambda x, i: F.get("w", place(i).cast("int"))), " ")
    found = runs.periodic_runs(docs.select("doc_id", F.when(F.col("n") > 0, rewritten).otherwise(F.col("text")).alias("text")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.col("best")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
                        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
                        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's host is its source."""
    found = hostrules.judged(read(spark, sf_dir, "documents"), keep=["doc_id"])
    failed = F.array_contains("failed", "few_words") | F.array_contains("failed", "repeats")
    return found.select("doc_id", *hostrules.MEASURES, failed.alias("base_failed"), (~failed & ~F.col("host_rejected")).alias("kept"))


def op13_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations are rebuilt: the first h turns come from the conversation of the next smaller id divisible by five."""
    turns = pin(turntrie.numbered_turns(read(spark, sf_dir, "conversations")), "turns")
    sizes = pin(turns.groupBy("conv").agg(F.max("pos").alias("n")), "sizes")
    base, h = F.col("conv") - F.col("conv") % 5, F.crc32(F.col("conv").cast("string")) % 9
    convs = sizes.select("conv", base.alias("base"), h.alias("h"))
    heads = turns.where("pos <= 8").select(F.col("conv").alias("base"), "pos", "x", "y", "bytes").join(convs, "base").where("pos <= h").select("conv", "pos", "x", "y", "bytes")
    lent = sizes.select(F.col("conv").alias("base"), F.col("n").alias("lent"))
    own = turns.withColumns({"base": base, "h": h}).where("pos > h").join(lent, "base", "left")
    moved = F.col("pos") - F.col("h") + F.least("h", F.coalesce("lent", F.lit(0)))
    rebuilt = heads.unionByName(own.select("conv", moved.alias("pos"), "x", "y", "bytes"))
    return turntrie.turn_trie(pin(rebuilt, "rebuilt"), sizes)


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination, "op2_url_filter": op2_url_filter, "op3_token_counts": op3_token_counts,
    "op4_simhash": op4_simhash, "op5_toxicity": op5_toxicity, "op6_quality": op6_quality, "op7_mixing": op7_mixing, "op8_sharding": op8_sharding,
    "op9_suffix_dedup": op9_suffix_dedup, "op10_topk": op10_topk, "op11_periodic_runs": op11_periodic_runs, "op12_host_rules": op12_host_rules,
    "op13_turn_trie": op13_turn_trie,
}

_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



def _permuted_sql() -> str:
    """The permutation of mixing.permuted over i, n and name, as nested SQL."""
    number = "('0x' || substr(md5('{0}|{1}|' || name), 1, 8))::bigint"
    prime = "(case " + " ".join(f"when n % {p} <> 0 then {p}" for p in mixing.PRIMES[:-1]) + f" else {mixing.PRIMES[-1]} end)"
    bits = "(length(bin(n)) - 1)"
    low = f"(1::bigint << {bits})"
    x = "i"
    for r in range(3):
        x = f"(({x}) * {prime} + {number.format(mixing.SEED, r)}) % n"
        if r < 2:
            y = f"((x * ({number.format(mixing.SEED, f'odd{r}')} % 1000000 * 2 + 1)) % {low})"
            x = f"list_transform([{x}], lambda x: case when x < {low} then xor({y}, {y} >> (({bits} + 1) // 2)::bigint) else x end)[1]"
    return x


_MIX_SQL = rf"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
       ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 3))::bigint as chunk from documents),
     t as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as s from d group by source),
     w as (select *, [5, 2, 1][(s - 1) % 3 + 1] as w, sum(source_size) over () * 1.5 as total from t),
     l as (select *, 2 * source_size / w as ratio, (total - coalesce(sum(2 * source_size) over upto, 0)) / (sum(w) over () - coalesce(sum(w) over upto, 0)) as level
           from w window upto as (order by 2 * source_size / w, s rows between unbounded preceding and 1 preceding)),
     g as (select *, case when ratio <= level then (2 * source_size)::double
                     else w * max(case when ratio > level then level end) over () end as target from l),
     e as (select s, source, source_size, target, floor(target + 0.5)::bigint as want, source_size // {mixing.BLOCK} as n, coalesce(source, chr(0) || 'null') as name from g),
     p as (select doc_id, s, source_size, target, want, size, n,
                  sum(size) over (partition by s order by chunk, doc_id, size rows unbounded preceding)::bigint - size as start
           from d join e on d.source is not distinct from e.source),
     c as (select doc_id, s, start, size, unnest(range(start // {mixing.BLOCK}, (start + size - 1) // {mixing.BLOCK} + 1)) as block from p where size > 0),
     slot as (select s, n, name, want % source_size as rest, unnest(range(0, n)) as i from e where source_size > 0),
     part as (select s, {_permuted_sql()} as block, least({mixing.BLOCK}, rest - i * {mixing.BLOCK}) as upto from slot where i * {mixing.BLOCK} < rest
              union all select s, n, least(source_size % {mixing.BLOCK}, want % source_size - n * {mixing.BLOCK}) from e
              where source_size > 0 and n * {mixing.BLOCK} < want % source_size),
     extra as (select c.s, c.start, sum(greatest(0, least(c.start + c.size, c.block * {mixing.BLOCK} + upto) - greatest(c.start, c.block * {mixing.BLOCK}))) as n
               from c join part on c.s = part.s and c.block = part.block group by c.s, c.start)
select p.doc_id, p.size, p.source_size, p.target,
       (case when p.size = 0 then 0 else p.size * (want // source_size) + coalesce(extra.n, 0) end)::bigint as taken
from p left join extra on p.s = extra.s and p.start = extra.start and p.size > 0"""

#: CRC-32 of the decimal digits of {0}, unsigned.
_CRC = """xor(4294967295, list_reduce([4294967295::bigint] || list_transform(string_split({0}::varchar, ''), lambda x: ascii(x)::bigint),
       lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))))"""


def _host_sql() -> str:
    """Measures within the text, rates per host and rule, the verdict."""
    names = list(hostrules.RULES)
    count = ", ".join(f"count(*) filter ({fails})::double as f_{r}" for r, (fails, _) in hostrules.RULES.items())
    sums = ", ".join(f"sum(f_{r}) / sum(n) as m_{r}, sum(f_{r} * f_{r} / n) as ff_{r}, sum(f_{r}) as fa_{r}" for r in names)
    parts = ", ".join(f"(ff_{r} - m_{r} * fa_{r}) / (hosts - 1) as b_{r}, (fa_{r} - ff_{r}) / (a - hosts) as w_{r}" for r in names)
    below = {r: f"(b_{r} + ((a - nn / a) / (hosts - 1) - 1) * w_{r})" for r in names}
    strength = ", ".join(f"case when hosts > 1 and a > hosts and {below[r]} > 0 then 1 / greatest({hostrules.LEAST}, least({hostrules.MOST}, (b_{r} - w_{r}) / {below[r]})) - 1 "
                         f"else {hostrules.LONE} end as s_{r}" for r in names)
    bad = " or ".join(f"(f_{r} + m_{r} * s_{r}) / (n + s_{r}) > {most}" for r, (_, most) in hostrules.RULES.items())
    return rf"""
with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from documents),
     g as (select r, i, array_to_string(w[i:i + 4], ' ') as g from (select r, w, unnest(range(1, len(w) - 3)) as i from d)),
     twice as (select r, i from (select r, i, count(*) over (partition by r, g) as c from g) where c > 1),
     rep as (select r, count(distinct x) as n from (select r, unnest(range(i, i + 5)) as x from twice) group by r),
     m as (select d.r, doc_id, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
                  (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
                  coalesce(n, 0)::bigint as n_repeat_words from d left join rep on d.r = rep.r),
     h as (select source, count(*)::double as n, {count} from m group by source),
     s as (select count(*) as hosts, sum(n) as a, sum(n * n) as nn, {sums} from h),
     p as (select *, {parts} from s),
     q as (select *, {strength} from p),
     v as (select source, {bad} as bad from h, q),
     f as (select m.*, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, bad from m join v on m.source is not distinct from v.source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not bad as kept from f"""


_TRIE_SQL = f"""
with t as (select conv_id as c, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} as u, turn from conversations where conv_id is not null),
     l as (select c, list(u order by turn nulls first, u.r, u.t) as w from t group by c),
     k as (select c, c - c % 5 as base, {_CRC.format('c')} % 9 as h, w from l),
     b as (select k.c, list_concat(coalesce(o.w[1:k.h], []), k.w[k.h + 1:]) as w from k left join l o on o.c = k.base),
     p as (select c, d, w[1:d] as path, len(w) = d as ends from (select c, w, unnest(range(0, len(w) + 1)) as d from b)),
     n as (select path, d, min(c) as conv_id, count(*) as n_convs, coalesce(strlen(path[d].t), 0) as bytes,
                  coalesce(string_agg(c::varchar, ',' order by c) filter (ends), '') as ids from p group by path, d),
     kids as (select path[1:d - 1] as path, count(*) as n from n where d > 0 group by 1),
     a as (select n.*, coalesce(kids.n, 0) as n_children from n left join kids on n.path = kids.path),
     below as (select path[1:x] as path, sum((n_children = 0)::int) as n_leaves, sum((n_convs - 1) * bytes) as saved
               from (select *, unnest(range(0, d + 1)) as x from a) group by 1)
select a.conv_id, a.d::bigint as depth, up.conv_id as parent_conv_id, a.n_convs, a.n_children::bigint as n_children, below.n_leaves::bigint as n_leaves,
       below.saved::bigint as saved_tokens, sha256(a.ids) as ends_sha256
from a join below on a.path = below.path left join a up on a.d > 0 and up.path = a.path[1:a.d - 1]"""

SQL: dict[str, str] = {
    "op12_host_rules": _host_sql(),
    "op13_turn_trie": _TRIE_SQL,
    "op1_decontamination": f"""
with d as (select doc_id, coalesce({_WORDS.format('text')}, []) as w from documents),
     i as (select item_id, {_WORDS.format('text')} as w from benchmark where text is not null),
     win as (select distinct item_id, array_to_string(list_slice(w, s, s + 9), ' ') as g, least(len(w), 10) as k
             from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as s from i where len(w) > 0)),
     gram as (select doc_id, k, p, array_to_string(list_slice(w, p, p + k - 1), ' ') as g
            from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as p from d, (select distinct k from win))),
     hit as (select gram.doc_id, gram.p, gram.k, win.item_id from gram join win on gram.g = win.g and gram.k = win.k),
     spot as (select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(p, p + k)) as x from hit) group by doc_id),
     own as (select doc_id, count(distinct item_id) as n_items,
                    array_to_string(list_sort(list_distinct(list(item_id::varchar))), ',') as ids from hit group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from d left join spot using (doc_id) left join own using (doc_id)""",
    "op2_url_filter": r"""
with rules(h, p, verdict) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'),
                                     ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
     r as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
     u as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r)
select page_id, host, path, arg_max(h || p, length(h || p)) as rule, coalesce(arg_max(verdict, length(h || p)), 'allow') as verdict
from u left join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id, host, path""",
    "op7_mixing": _MIX_SQL,
    "op10_topk": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as c from embeddings
           where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
     s as (select q.vec_id as query_id, o.vec_id, list_inner_product(q.c, o.c)::bigint as score
           from v q join v o on q.vec_id <> o.vec_id where q.vec_id % 50 = 0)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5""",
}
