"""URL filter: path rules by host, and a blocked Bloom filter before an exact join with listed URLs.

Everything is DataFrame expressions. Listed URLs are made canonical and set PROBES bits in one 512-bit
block each; blocks are built by ``bit_or`` in a group-by, so the filter is a table with one row per
block in use. Pages whose bits are all set are possible hits, and only these go through the exact hash
join with the list, which removes the false positives. The filter is broadcast up to BROADCAST_BLOCKS
blocks and joined by block beyond that.

A null URL or one without ``://`` has an empty host and path, fits no rule and is never listed. Repeated
rows get equal verdicts, empty tables give empty results, other columns of the pages are kept whatever
their names, and columns named like a result are replaced. Long URLs are judged whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .names import plain

BITS_PER_URL = 12
PROBES = 6
BROADCAST_BLOCKS = 1 << 16   # 4.7 MB
_WORDS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULTS = ["host", "path", "rule", "listed", "verdict"]


@dataclass(frozen=True)
class Rule:
    """Fits a host and its subdomains where the path starts with the rule's."""

    verdict: str   # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    """From behind the first ``://`` to the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """From behind the host to the next ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """One spelling: no scheme, query or fragment, no ``www.``, ``.html`` or closing slashes; null without a host."""
    spelled = F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"(/index)?(\.html?)?/*$", ""))
    return F.when(host != "", spelled)


def best_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits, null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):  # the longest is asked first
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _bits(url: Column) -> list[tuple[Column, Column]]:
    """(word, bit) of each probe: nine bits of a second hash."""
    second = F.xxhash64(url, F.lit(1))
    places = [F.shiftright(second, 9 * i).bitwiseAND(511) for i in range(PROBES)]
    return [(F.shiftright(p, 6).cast("int"), p.bitwiseAND(63).cast("int")) for p in places]


def blocks_for(urls: int) -> int:
    """A power of two with BITS_PER_URL bits for each URL."""
    return 1 << max(0, (max(1, urls) * BITS_PER_URL - 1) // 512).bit_length()


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w7) of the URLs in column ``canonical``."""
    one = F.lit(1).cast("long")
    bits = listed.select(_block(F.col("canonical"), blocks).alias("block"), F.array(*[
        F.struct(w.alias("word"), F.call_function("shiftleft", one, b).alias("bit")) for w, b in _bits(F.col("canonical"))]).alias("bits"))
    words = [
        F.bit_or(F.aggregate("bits", F.lit(0).cast("long"), _or_of(j))).alias(f"w{j}") for j in range(_WORDS)]
    return bits.groupBy("block").agg(*words)


def possible(rows: DataFrame, key: Column, bloom: DataFrame, blocks: int) -> DataFrame:
    """``rows`` with ``__possible``: false only where the filter rules the key out."""
    probed = rows.withColumn("__key", key).withColumn("__block", _block(F.col("__key"), blocks)).join(
        (F.broadcast(bloom) if blocks <= BROADCAST_BLOCKS else bloom).withColumnRenamed("block", "__block"), "__block", "left")
    words = F.array(*[F.col(f"w{j}") for j in range(_WORDS)])
    hit = F.col("w0").isNotNull()
    for w, b in _bits(F.col("__key")):
        hit = hit & (F.call_function("shiftright", F.get(words, w), b).bitwiseAND(1) == 1)
    return probed.withColumn("__possible", F.coalesce(hit, F.lit(False))).drop("__key", "__block", *[f"w{j}" for j in range(_WORDS)])


def _or_of(word: int):
    def step(found: Column, probe: Column) -> Column:
        return F.when(probe["word"] == word, found.bitwiseOR(probe["bit"])).otherwise(found)
    return step


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule], url: str = "url", listed_url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``listed`` and ``verdict``.

    The verdict is the rule's where one fits, else ``block`` for a listed URL and ``allow`` for others.
    """
    known = F.col(listed_url)
    urls = listed.select(canonical(host(known), path(known)).alias("canonical")).where("canonical is not null").distinct()
    blocks = blocks_for(urls.count())
    bloom = bloom_filter(urls, blocks)
    kept = [c for c in pages.columns if c.lower() not in RESULTS]
    inner = plain(kept)
    if url.lower() in RESULTS:
        raise ValueError(f"the column of URLs may not be named {url}")
    parsed = pages.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, inner)], host(F.col(f"`{url}`")).alias("host"), path(F.col(f"`{url}`")).alias("path"))
    text, verdict = best_rule(rules, F.col("host"), F.col("path"))
    parsed = parsed.select("*", text.alias("rule"), verdict.alias("verdict"), canonical(F.col("host"), F.col("path")).alias("__url"))
    probed = possible(parsed, F.col("__url"), bloom, blocks)
    probed = probed.withColumn("__possible", F.col("__possible") & F.col("__url").isNotNull())
    columns = [*inner, "host", "path", "rule", "verdict"]
    missed = probed.where(~F.col("__possible")).select(*columns, F.lit(False).alias("listed"))
    # The exact join: rows that only share bits with a listed URL find no partner.
    exact = urls.select(F.col("canonical").alias("__url"), F.lit(True).alias("__found")).hint("shuffle_hash")
    hit = probed.where("__possible").join(exact, "__url", "left").select(*columns, F.coalesce("__found", F.lit(False)).alias("listed"))
    judged = F.coalesce("verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    return missed.union(hit).select(*[F.col(n).alias(c) for c, n in zip(kept, inner)], "host", "path", "rule", "listed", judged.alias("verdict"))
