"""The queries over the driver's tables that apply the operators of this subpackage, and their SQL where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crateflow.llm import byte_bpe, divergence, embedding_dedup, importance, jaccard_join, language_id, lm_scoring, secret_scan, sharding, source_mix, topk_search, toxicity, url_filter
from crateflow.llm.runtime import bucket_of, small_batches

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm_scoring.score(docs, bucket_of("doc_id", 5) != 1)
    return scored.select("doc_id", (~F.col("trains")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", bucket_of("doc_id", 4) == 2)
    model = language_id.learn(docs.where(~F.col("held_out")))
    return language_id.predict(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


#: Target weights of op10: domains come from the source's number, which stands in for a domain column.
MIX_LEVELS = (
    source_mix.Level("domain", {"d0": 4, "d1": 3, "d2": 2, "d3": 1}),
    source_mix.Level("lang", {"en": 5, "de": 2, "fr": 2, "es": 1}),
    source_mix.Level("source", {"src0": 3}),
)
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.75, 3, 17


def domain_of(source: str = "source") -> Column:
    """The last two bits of the number in the source's name; d0 where there is no number."""
    return F.concat(F.lit("d"), F.coalesce(F.expr(f"try_cast(regexp_extract({source}, '[0-9]+', 0) as bigint)"), F.lit(0)) % 4)


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").withColumn("domain", domain_of())
    mixed = source_mix.mix(docs, MIX_LEVELS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)
    return mixed.select("doc_id", "domain", "lang", "source", "n_tokens", "leaf_tokens", "leaf_budget", "n_copies")


def _sql_weight(level: source_mix.Level) -> str:
    cases = " ".join(f"when {level.column} = '{v}' then {w}" for v, w in level.weights.items())
    return f"(case {cases} else {level.default} end)"


def mix_sql(share: float = MIX_SHARE, epochs: int = MIX_EPOCHS, seed: int = MIX_SEED) -> str:
    """Water-filling level by level, then a running sum over each leaf."""
    columns = [v.column for v in MIX_LEVELS]
    steps = []
    for k, level in enumerate(MIX_LEVELS):
        here, parents = columns[: k + 1], columns[:k]
        keys = ", ".join(here)
        among = f"partition by {', '.join(parents)}" if parents else ""
        joined = " and ".join(f"p.{c} is not distinct from c.{c}" for c in parents) or "true"
        parent = f"b{k - 1}" if k else f"(select cast(floor(sum(tokens) * {share}) as bigint) as b from leaves)"
        steps.append(f"""
    c{k} as (select {keys}, cast(sum(tokens) * {epochs} as hugeint) as c, cast({_sql_weight(level)} as hugeint) as w from leaves group by {keys} having sum(tokens) > 0),
    j{k} as (select c.*, cast(p.b as hugeint) as b from c{k} c join {parent} p on {joined}),
    o{k} as (select *, coalesce(sum(c) over (o rows between unbounded preceding and 1 preceding), 0)::hugeint as c0, sum(w) over (o rows between current row and unbounded following)::hugeint as w1
      from j{k} window o as ({among} order by c::double / w::double, {here[-1]})),
    f{k} as (select *, b >= c0 and c * w1 <= (b - c0) * w as f from o{k}),
    r{k} as (select *, b - coalesce(sum(case when f then c end) over ({among}), 0)::hugeint as rest, (sum(case when not f then w end) over ({among}))::hugeint as open from f{k}),
    b{k} as (select {keys}, case when f then c else rest * w // open end as b from r{k})""")
    last, names = len(MIX_LEVELS) - 1, ", ".join(columns)
    match = " and ".join(f"l.{c} is not distinct from b.{c}" for c in columns)
    back = " and ".join(f"d.{c} is not distinct from l.{c}" for c in columns)
    return f"""
    with docs as (select doc_id, lang, source, 'd' || (coalesce(try_cast(regexp_extract(source, '[0-9]+') as bigint), 0) % 4) as domain, substr(md5(coalesce(text, '')), 1, 8) as mark,
        coalesce(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')), 0) as n_tokens from documents),
    leaves as (select {names}, sum(n_tokens)::bigint as tokens from docs group by {names}),{",".join(steps)},
    l as (select l.*, coalesce(b.b, 0)::bigint as budget, case when tokens > 0 then (coalesce(b.b, 0) // tokens)::bigint else 0 end as e from leaves l left join b{last} b on {match}),
    k as (select d.*, l.tokens, l.budget, l.e, l.budget - l.e * l.tokens as rest,
        ('0x' || substr(md5(concat_ws(':', '{seed}', (l.e + 1)::varchar, coalesce(d.doc_id::varchar, ''), d.mark)), 1, 12))::bigint as key from docs d join l on {back}),
    s as (select *, sum(n_tokens) over (partition by {names} order by key range between unbounded preceding and current row) as upto from k)
    select doc_id, domain, lang, source, n_tokens::bigint as n_tokens, tokens as leaf_tokens, budget as leaf_budget,
        (case when n_tokens > 0 then e + case when rest > 0 and upto <= rest then 1 else 0 end else 0 end)::bigint as n_copies from s"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", bucket_of("doc_id", 5) == 0)
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.learn(docs.where(~F.col("held_out")), labels.where(bucket_of("doc_id", 5) != 0))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20, 64)


#: Every query against every row.
TOPK_SQL = """
    with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
        where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.v, c.v)::bigint as score from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id)
    select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s qualify rank <= 20"""


URL_RULES = (
    url_filter.UrlRule("net", "/", "block"),
    url_filter.UrlRule("example.net", "/en/", "allow"),
    url_filter.UrlRule("example.com", "/de/", "block"),
    url_filter.UrlRule("org", "/fr/", "allow"),
)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "value", "threshold")


def _url_sql() -> str:
    """The models from one list of windows; each context length joins the shorter one."""
    order, unit, step = url_filter.ORDER, url_filter.UNIT, url_filter.STEP
    fits = " ".join(f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then '{r.name}'" for r in sorted(URL_RULES, key=lambda r: -len(r.name)))
    says = "case rule " + " ".join(f"when '{r.name}' then '{r.verdict}'" for r in URL_RULES) + " end"
    levels = []
    for k in range(1, order + 2):
        q = "1.0::double / 256 as qa, 1.0::double / 256 as qb from c1 c" if k == 1 else f"l.pa as qa, l.pb as qb from c{k} c join l{k - 1} l on l.g = substr(c.g, 2)"
        p = ", ".join(f"case when n{c} = 0 then q{c} else (m{c}::double + t{c}::double * q{c}) / (n{c}::double + t{c}::double) end as p{c}" for c in "ab")
        levels.append(f"""
    g{k} as (select right(gram, {k}) as g, sum(a) as ma, sum(b) as mb from grams group by 1),
    c{k} as (select *, sum(ma) over w as na, sum(mb) over w as nb, count(*) filter (ma > 0) over w as ta, count(*) filter (mb > 0) over w as tb from g{k} window w as (partition by left(g, {k - 1}))),
    l{k} as (select g, {p} from (select c.*, {q}))""")
    return f"""
    with p0 as (select page_id, coalesce(url, '') as u, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) as rest from pages),
    p1 as (select page_id, u, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) as path from p0),
    p2 as (select *, case {fits} end as rule from p1),
    p3 as (select *, {says} as known, ('0x' || substr(md5(u), 1, 8))::bigint % {url_filter.FOLDS} as fold from p2),
    urls as (select u, any_value(known) as known, any_value(fold) as fold, count(*) as n from p3 group by u),
    padded as (select *, repeat(chr(2), {order}) || u || chr(3) as s from urls),
    spots as (select u, n, known, fold, substr(s, i, {order + 1}) as gram from (select *, unnest(range(1, length(s) - {order} + 1)) as i from padded)),
    grams as (select gram, coalesce(sum(n) filter (fold <> 0 and known = 'allow'), 0) as a, coalesce(sum(n) filter (fold <> 0 and known = 'block'), 0) as b from spots group by gram),{",".join(levels)},
    v as (select u, floor(sum(round((ln(pa) - ln(pb)) * {unit})::bigint)::double / count(*))::bigint as value from spots join l{order + 1} on g = gram group by u),
    h as (select floor(value / {step}.0)::bigint as step, coalesce(sum(n) filter (known = 'allow'), 0) as a, coalesce(sum(n) filter (known = 'block'), 0) as b from urls join v using (u) where fold = 0 and known is not null group by 1),
    o as (select step as t from h union select step + 1 from h union select 0),
    e as (select t, (select coalesce(sum(a) filter (step >= t), 0) * sum(b) + coalesce(sum(b) filter (step < t), 0) * sum(a) from h) as gain from o),
    best as (select coalesce((select case when (select sum(a) * sum(b) from h) > 0 then first(t order by gain desc, abs(t), t) else 0 end from e), 0) * {step} as threshold)
    select page_id, host, path, rule, value, threshold::bigint as threshold, coalesce(known, case when value >= threshold then 'allow' else 'block' end) as verdict
    from p3 left join v using (u), best"""


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.near_copies(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "text_class", "n_links", "n_text_links", "kept")


#: All pairs that share an n-gram, so for small tables only. lower() lowers other letters too, hence translate().
JACCARD_SQL = r"""
    with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
    s as (select distinct doc_id, array_to_string(words[i : i + 4], ' ') as g from (select doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) as i from w where len(words) > 0)),
    n as (select doc_id, count(*) as n, md5(string_agg(g, chr(10) order by g)) as same from s group by doc_id),
    p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
    l as (select p.a, p.b, x.same <> y.same as other, y.same as kind from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where c >= 0.8 * (x.n + y.n - c) - 1e-9),
    r as (select doc_id as a, doc_id as b from documents union select r.a, l.b from r join l on r.b = l.a),
    c as (select a as doc_id, min(b) as class_id from r group by a),
    k as (select a as doc_id, count(*) as n_links, count(distinct kind) filter (other) as n_text_links from l group by a),
    t as (select doc_id, min(doc_id) over (partition by same) as text_class from n)
    select doc_id, class_id, coalesce(text_class, doc_id) as text_class, coalesce(n_links, 0)::bigint as n_links, coalesce(n_text_links, 0)::bigint as n_text_links, doc_id = class_id as kept
    from c left join k using (doc_id) left join t using (doc_id)""".replace("\\\\", "\\")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _secret_sql() -> str:
    """Per rule, the running sum of the lengths of pieces and matches; no index."""
    rules = secret_scan.BASE_RULES + secret_scan.MORE_RULES
    parts = []
    for k, r in enumerate(rules):
        p = "'" + r.pattern.replace("'", "''") + "'"
        parts.append(f"""
      select rid, {k} as position, '{r.kind}' as kind, i, length(pieces[i]) + length(whole[i]) as step, length(whole[i]) as size, length(part[i]) >= {r.least} as counts
      from (select rid, regexp_split_to_array(text, {p}) as pieces, regexp_extract_all(text, {p}, 0) as whole, regexp_extract_all(text, {p}, {r.group}) as part from d where regexp_matches(text, {p})),
        lateral (select unnest(range(1, len(whole) + 1)) as i)""")
    base = len(secret_scan.BASE_RULES)
    item = "kind || ':' || s || ':' || e"
    return f"""
    with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
    m as ({" union all ".join(parts)}),
    ends as (select *, sum(step) over (partition by rid, position order by i)::bigint as e from m),
    span as (select rid, position, kind, e - size as s, e from ends where counts),
    doc as (select rid, {", ".join(f"count(*) filter (kind = '{r.kind}') as n_{r.kind}" for r in secret_scan.BASE_RULES)},
        string_agg({item}, ',' order by s, position) filter (position < {base}) as basic, string_agg({item}, ',' order by s, position) as everything from span group by rid)
    select doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::bigint as n_{r.kind}" for r in secret_scan.BASE_RULES)},
        sha256(coalesce(basic, '')) as base_sha256, coalesce(everything, '') as spans from d left join doc using (rid)"""


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


#: Every pair of a label.
DEDUP_SQL = """
    with recursive v as (select vec_id, label, embedding::double[] as v from embeddings where label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
    l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.98),
    r as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from r join l on r.b = l.a)
    select a as vec_id, (select count(*) from l where l.a = r.a) as n_links, min(b) as component_id, a = min(b) as kept from r group by a"""


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    words = byte_bpe.vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = byte_bpe.round_trip(docs, words)
    return coded.select(
        "doc_id",
        F.expr("length(token_ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents").select("lang", "source", "text"))


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Every group against every term.
DIVERGENCE_SQL = rf"""
    with docs as (select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source, {_LOWERED} as t from documents),
    w as (select rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
    kept as (select lang, term, count(*)::hugeint as total from w group by all having count(distinct rid) >= 3),
    v as (select lang, count(*)::hugeint as v, sum(total)::hugeint as nl from kept group by lang),
    g as (select distinct lang, source from docs),
    c as (select lang, source, term, count(*)::hugeint as n from w semi join kept using (lang, term) group by all),
    s as (select lang, source, coalesce(sum(n), 0)::hugeint as n from g left join c using (lang, source) group by all),
    p as (select s.lang, s.source, k.term, coalesce(c.n, 0) as n, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 1) // (s.n + v.v) as p, 1 + 1000000000::hugeint * (k.total + 1) // (v.nl + v.v) as q
      from s join v using (lang) join kept k using (lang) left join c on c.lang = s.lang and c.source = s.source and c.term = k.term),
    pairs as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p)::bigint as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
    found as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(pairs.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source
      union all select lang, source, 'term', term, ((p - q) * (p - q) // q)::bigint from p where n > 0 and p > q)
    select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from found qualify part = 'pair' or rank <= 200"""

SHARDS = 40


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.placed(_table(spark, sf_dir, "documents").select("doc_id", "text"), sharding.regular(SHARDS))
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


#: The checksum's table, made bit by bit, and a checksum as a fold over the bytes of `{}`.
_CRC_TABLE = "tab as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as tab)"
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({})), '..'), lambda x: ('0x' || x)::bigint)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


def _sharding_sql() -> str:
    """Every child of the node that a key has reached, level by level, in the tree and the grown one."""
    trees = {"shard": sharding.regular(SHARDS), "grown_shard": sharding.regular(SHARDS).grown()}
    steps, ends = [], []
    for name, tree in trees.items():
        for k, level in enumerate(tree.levels()):
            rows = ", ".join(f"({at}, '{child}', {weight}::double, {place})" for at, children in enumerate(level) for child, weight, place in children)
            draw = f"-ln((('0x' || substr(md5(child || ':' || key), 1, {sharding.DIGITS}))::bigint::double + 0.5) / {float(16**sharding.DIGITS)}::double) / weight"
            before = f"{name}{k - 1}" if k else "(select rid, key, 0 as node from d)"
            steps.append(f"{name}{k} as (select rid, any_value(key) as key, arg_min(place, {draw}) as node from {before} join (values {rows}) as t(parent, child, weight, place) on parent = node group by rid)")
        ends.append(f"(select rid, node::int as {name} from {name}2)")
    return f"""
    with d as (select row_number() over () as rid, doc_id, coalesce(doc_id::varchar, '') as key, coalesce(text, '') as t from documents), {_CRC_TABLE},
    {", ".join(steps)}
    select doc_id, strlen(t)::bigint + {sharding.ROW_BYTES} as size, {_CRC.format("t")} as text_crc32, '{sharding.LAW}' as law, shard, row_number() over (partition by shard order by doc_id, rid) - 1 as slot, grown_shard
    from d join {ends[0]} using (rid) join {ends[1]} using (rid), tab"""


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.resample(docs, _table(spark, sf_dir, "benchmark").select("text")).select("doc_id", "n_features", "weight", "score", "rank")


def _importance_sql() -> str:
    s = importance.Settings()
    words = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
    with d as (select row_number() over () as rid, doc_id, {words} as words from documents), {_CRC_TABLE},
    dw as (select rid, word, count(*) as n from (select rid, unnest(words) as word from d) group by all),
    bw as (select unnest({words}) as word from benchmark),
    hashed as (select word, {_CRC.format("word")} % {s.buckets} as bucket from (select word from dw union select word from bw), tab),
    s as (select bucket, sum(n) as s from dw join hashed using (word) group by bucket),
    t as (select bucket, count(*) as t from bw join hashed using (word) group by bucket),
    gains as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select coalesce(sum(s), 0) from s) + {s.buckets})::double / ((coalesce(s, 0) + 1)::double * ((select coalesce(sum(t), 0) from t) + {s.buckets})::double)))::bigint as gain
      from s full join t using (bucket)),
    sums as (select rid, sum(n * gain)::bigint as total, sum(n)::bigint as n from dw join hashed using (word) join gains using (bucket) group by rid),
    w as (select rid, doc_id, len(words) as n_words, coalesce(n, 0) as n_features, case when n > 0 then (total - ((total % n) + n) % n) // n else 0 end as weight from d left join sums using (rid)),
    sc as (select *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('{s.seed}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint::double + 0.5) / 4294967296.0::double)))::bigint as score from w),
    r as (select *, n_words >= {s.least_words} as able, row_number() over (partition by n_words >= {s.least_words} order by score desc, doc_id, rid) as place from sc)
    select doc_id, n_features, weight, score, case when able and place <= {s.percent} * (select count(*) from r where able) // 100 then place end as rank from r"""


QUERIES: dict[str, Query] = {"op1_lm_scoring": op1_lm_scoring, "op2_language_id": op2_language_id, "op3_toxicity": op3_toxicity, "op4_topk_search": op4_topk_search, "op5_url_filter": op5_url_filter, "op6_jaccard_join": op6_jaccard_join, "op7_secret_scan": op7_secret_scan, "op8_embedding_dedup": op8_embedding_dedup, "op9_byte_bpe": op9_byte_bpe, "op10_source_mix": op10_source_mix, "op11_source_divergence": op11_source_divergence, "op12_sharding": op12_sharding, "op13_importance_resampling": op13_importance_resampling}
ORACLES: dict[str, str] = {"op4_topk_search": TOPK_SQL, "op8_embedding_dedup": DEDUP_SQL, "op6_jaccard_join": JACCARD_SQL, "op5_url_filter": _url_sql(), "op7_secret_scan": _secret_sql(), "op10_source_mix": mix_sql(), "op11_source_divergence": DIVERGENCE_SQL, "op12_sharding": _sharding_sql(), "op13_importance_resampling": _importance_sql()}
