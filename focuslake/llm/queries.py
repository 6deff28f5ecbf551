"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, decontaminate, jaccard, lines, lm, mixing, neighbours, phrases, secret_scan, tokens, toxicity, urls, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(query):
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@register("op12_byte_bpe")
def op12_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every text under a byte-level vocabulary, and the bytes they decode to, as digests."""
    ranks = tokenizer_path("byte_bpe_50k.tiktoken")
    return bpe.digest(bpe.decode(bpe.encode(table(spark, folder, "documents"), ranks, split_pattern()), ranks))


@register("op11_collocations", r"""
    with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents),
    worded as (select lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') as ws from pieces),
    spans as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from worded),
    grams as (select lang, unnest([ws[i:i], ws[i:i + 1], ws[i:i + 2]]) as g, unnest([1, 2, 3]) as k, i, len(ws) as size from spans),
    f as (select lang, g, count(*) as f from grams where i + k - 1 <= size group by all),
    totals as (select lang, sum(f) as n from f where len(g) = 1 group by 1),
    found as (select lang, g, f as a from f where len(g) > 1 and f >= 10),
    cuts as (select lang, g, a, unnest(range(1, len(g))) as k from found),
    parts as (select c.*, x.f as l, y.f as r, (1000000::hugeint * a * a) // (x.f::hugeint * y.f) as score from cuts c
        join f x on x.lang = c.lang and x.g = c.g[1:k] join f y on y.lang = c.lang and y.g = c.g[k + 1:]),
    worst as (select lang, g, any_value(a) as a, arg_min(l, score * 10 + k) as l, arg_min(r, score * 10 + k) as r, min(score) as score
        from parts group by 1, 2),
    longer as (select lang, s as g, max(a) as b from (select lang, a, unnest([g[1:2], g[2:3]]) as s from found where len(g) = 3) group by 1, 2),
    ranked as (select w.*, array_to_string(w.g, ' ') as phrase, row_number() over (partition by w.lang
            order by score desc, a desc, array_to_string(w.g, ' ')) as rank
        from worst w left join longer o on o.lang = w.lang and o.g = w.g where b is null or 100 * b < 50 * a)
    select lang, rank, phrase, a, l, r, n::bigint as n, score::bigint as score from ranked join totals using (lang) where rank <= 2000""")
def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The 2,000 strongest phrases of two and three words in every language."""
    return phrases.collocations(table(spark, folder, "documents"))


@register("op13_whitening")
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every embedding on the 16 first principal components, at unit variance."""
    return whitening.whiten(table(spark, folder, "embeddings"))


@register("op8_token_ids")
def op8_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every text, written to files by frequency rank and read back."""
    return tokens.digest(tokens.store_ids(table(spark, folder, "documents"), tokenizer_path()))


# Shingles as lists of five lower-cased words; texts of one to four words have one shorter shingle.
_SETS = r"""
    words as (select doc_id, list_filter(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
    sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
            else list_sort(list_distinct(list_transform(range(1, len(w) - 3),
                lambda i: array_to_string(w[i:i + 4], ' ')))) end as s from words),
    keyed as (select doc_id, md5(array_to_string(s, chr(1))) as k, s, len(s) as n from sets),
    classes as (select k, min(doc_id) as class_id, any_value(s) as s, any_value(n) as n from keyed group by k),
    items as (select k, n, unnest(s) as item from classes),
    common as (select a.k as a, b.k as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c
        from items a join items b on a.item = b.item and a.k < b.k group by 1, 2),
    links as (select a, b from common where c / (na + nb - c) >= 0.8),
    paired as (select a, b from links union all select b, a from links)
"""


@register("op5_ngram_jaccard_join", f"""
    with recursive {_SETS},
    reach as (select k as a, k as b from classes union select r.a, l.b from reach r join paired l on r.b = l.a),
    lows as (select r.a as k, min(c.class_id) as group_id from reach r join classes c on c.k = r.b group by 1),
    counts as (select a as k, count(*) as n_links from paired group by 1)
    select d.doc_id, l.group_id as class_id, c.class_id as copy_id, coalesce(n.n_links, 0) as n_links
    from keyed d join classes c using (k) join lows l using (k) left join counts n using (k)""")
def op5_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its class of near copies, its exact copies and its number of links, at a similarity of 0.8.

    ``class_id`` is the least id of all documents that links connect, ``copy_id`` that of the documents
    with the same shingles, ``n_links`` counts the other sets of shingles it is linked to.
    """
    found = jaccard.similar(table(spark, folder, "documents"))
    return found.select("doc_id", F.col("group_id").alias("class_id"), F.col("class_id").alias("copy_id"), "n_links")


@register("op10_line_dedup", r"""
    with parts as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
    flat as (select doc_id, unnest(l) as line, unnest(range(len(l))) as no from parts),
    worded as (select doc_id, no, line, array_to_string(ws, ' ') as body, len(ws) as words
        from (select *, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from flat)),
    full_lines as (select *, row_number() over (partition by doc_id order by no) as i,
        sum(words) over (partition by doc_id order by no) as upto from worded where words > 0),
    docs as (select doc_id, list(body order by i) as b, list(no order by i) as nos, list(upto order by i) as c from full_lines group by 1),
    ends as (
        select f.doc_id, f.i as a, (select min(g.i) from full_lines g where g.doc_id = f.doc_id and g.upto - f.upto + f.words >= 50) as z
        from full_lines f
        union
        select f.doc_id, (select max(g.i) from full_lines g where g.doc_id = f.doc_id and f.upto - g.upto + g.words >= 50), f.i
        from full_lines f),
    runs as (select e.doc_id, nos[a] as first, nos[z] as last, md5(array_to_string(b[a:z], chr(10))) as run
        from ends e join docs d using (doc_id) where a is not null and z is not null),
    placed as (select *, first_value(doc_id) over w as doc0, first_value(last) over w as last0
        from runs window w as (partition by run order by doc_id, first, last)),
    gone as (select distinct f.doc_id, f.no from placed p join full_lines f
        on f.doc_id = p.doc_id and f.no between p.first and p.last where not (p.doc_id = doc0 and p.first <= last0)),
    kept as (select w.doc_id, string_agg(w.line, chr(10) order by w.no) filter (where g.no is null) as text, count(g.no) as n_removed,
        count(*) filter (where words > 0) as n_lines from worded w left join gone g on g.doc_id = w.doc_id and g.no = w.no group by 1)
    select doc_id, n_lines, n_removed, md5(coalesce(text, '')) as text_md5 from kept""")
def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines, removed lines and the digest of the text that is left, for every document."""
    cleaned = lines.dedup_lines(table(spark, folder, "documents"))
    left = F.coalesce("text", F.lit(""))
    full = F.size(F.filter(F.split(left, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return cleaned.select("doc_id", (full + F.size("removed")).cast("long").alias("n_lines"),
                          F.size("removed").cast("long").alias("n_removed"), F.md5(left).alias("text_md5"))


@register("op2_secret_scan")
def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of secrets in every whole text."""
    return secret_scan.digest(secret_scan.find_secrets(table(spark, folder, "documents")))


CATEGORIES = ["low_quality", "toxic"]


def toxic_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The labels in order of the chain: text of low quality first, then abuse."""
    return table(spark, folder, "labels").select("doc_id", (F.col("quality") == 0).alias("low_quality"), (F.col("toxic") == 1).alias("toxic"))


def toxicity_scores(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    chain = toxicity.train(docs, toxic_labels(spark, folder), CATEGORIES)
    return toxicity.score(docs, chain)


@register("op7_toxicity")
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Probability of each category for every document, and whether it is toxic."""
    scored = toxicity_scores(spark, table(spark, folder, "documents"), folder)
    return scored.select("doc_id", *[f"p_{c}" for c in CATEGORIES], "is_toxic")


@register("op6_decontamination")
def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items that documents hold, with the edits between them."""
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


# Fixed values of the contract: rules by host and path.
URL_RULES = [urls.Rule("block", "com", "/en/"), urls.Rule("allow", "example.com", "/en/7"), urls.Rule("allow", "net", "/de/"),
             urls.Rule("block", "example.net", "/de/8"), urls.Rule("block", "org", "/es/")]
_RULES_SQL = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)


@register("op1_url_filter", rf"""
    with rules(verdict, host, path) as (values {_RULES_SQL}),
    rest as (select *, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as r from pages),
    parsed as (select page_id, html,
        translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from rest),
    spelled as (select *, case when host <> '' then regexp_replace(host, '^www\.', '')
        || regexp_replace(path, '(/index)?(\.html?)?/*$', '') end as c from parsed),
    listed as (select distinct c from spelled where c is not null and not ends_with(html, '</html>')),
    ruled as (select s.page_id, arg_max(r.host || r.path, length(r.host || r.path)) as rule, arg_max(r.verdict, length(r.host || r.path)) as rv
        from spelled s join rules r on (s.host = r.host or ends_with(s.host, '.' || r.host)) and starts_with(s.path, r.path) group by 1)
    select s.page_id, s.host, s.path, r.rule, l.c is not null as listed,
        coalesce(r.rv, case when l.c is not null then 'block' else 'allow' end) as verdict
    from spelled s left join ruled r using (page_id) left join listed l on l.c = s.c""")
def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page; the list holds the URLs of pages that broke off before ``</html>``."""
    pages = table(spark, folder, "pages")
    listed = pages.where(~F.col("html").endswith("</html>")).select("url")
    return urls.filter_urls(pages.select("page_id", "url"), listed, URL_RULES).select("page_id", "host", "path", "rule", "listed", "verdict")


def topic(text) -> "F.Column":
    """A document's form: licence notes, rows of signs, contact data or plain prose."""
    plain = F.coalesce(text, F.lit(""))
    signs = F.length(plain) - F.length(F.translate(plain, "#$%&*|", ""))
    return (F.when(plain.contains("License"), "licence").when(signs * 20 > F.length(plain), "signs")
            .when(plain.contains("@"), "contact").otherwise("prose"))


# Powers of the observed shares that the mixture aims at.
TEMPERS = {"source": 0.5, "lang": 0.7, "topic": 0.3}
MIX_SHARE = 0.5


def mix_documents(docs: DataFrame) -> DataFrame:
    dimensions = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic(F.col("text"))}
    return mixing.mixed(docs, dimensions, lambda cells: {d: mixing.tempered(cells, d, p) for d, p in TEMPERS.items()}, MIX_SHARE)


def _mixing_sql(documents: str = "documents", sweeps: int = 60, fills: int = 12) -> str:
    """The same fit with a fixed number of sweeps, each a step of its own."""
    parts = [f"""d as materialized (select doc_id, source, lang,
            case when contains(t, 'License') then 'licence'
                 when (length(t) - length(translate(t, '#$%&*|', ''))) * 20 > length(t) then 'signs'
                 when contains(t, '@') then 'contact' else 'prose' end as topic,
            len(list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) as tokens
        from (select *, coalesce(text, '') as t from {documents}))""",
             "c as materialized (select source, lang, topic, cast(sum(tokens) as double) as tokens from d group by all)"]
    for k, p in TEMPERS.items():
        parts.append(f"t_{k} as materialized (select v, s / sum(s) over () as s from (select {k} as v, pow(sum(tokens), {p}) as s from c group by 1))")
    parts.append("w0 as materialized (select *, tokens / sum(tokens) over () as w from c)")
    n = 0
    for _ in range(sweeps):
        for k in TEMPERS:
            parts.append(f"""w{n + 1} as materialized (select x.* exclude (w), w * s / sum(w) over (partition by {k}) as w
                from w{n} x join t_{k} on {k} is not distinct from v)""")
            n += 1
    parts.append("f0 as materialized (select 0e0 as scale)")
    for i in range(fills):
        parts.append(f"""f{i + 1} as materialized (select greatest(any_value(scale), ({MIX_SHARE} * sum(tokens) - coalesce(sum(tokens) filter (w * scale >= tokens), 0))
            / sum(w) filter (w * scale < tokens)) as scale from w{n}, f{i})""")
    parts.append(f"p as materialized (select source, lang, topic, case when tokens > 0 then least(1, scale * w / tokens) else 1 end as probability from w{n}, f{fills})")
    return f"""with {", ".join(parts)}
        select doc_id, d.source, d.lang, d.topic, round(probability, 5) as probability,
            cast('0x' || substr(md5('mix:' || doc_id), 1, 12) as bigint) / 281474976710656.0 < probability as selected
        from d join p on d.source is not distinct from p.source and d.lang is not distinct from p.lang and d.topic = p.topic"""


@register("op4_source_mixing", _mixing_sql())
def op4_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Probability of every document in the mixture, and whether it is drawn."""
    mix = mix_documents(table(spark, folder, "documents"))
    return mix.select("doc_id", F.col("mixing_source").alias("source"), F.col("mixing_lang").alias("lang"),
                      F.col("mixing_topic").alias("topic"), F.round("probability", 5).alias("probability"), "selected")


@register("op9_nearest_neighbours")
def op9_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of every hundredth, by Euclidean distance."""
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@register("op3_lm_scoring")
def op3_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of every whole text under the unigram base and under the mixing model."""
    return lm.scores(table(spark, folder, "documents"))
