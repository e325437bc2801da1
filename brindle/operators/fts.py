"""Full-text search: analyzers, inverted index, query trees and BM25.

An index is three DataFrames: tokens (one row for each kept token and its place), document
lengths, and statistics of fields.  ``stored`` writes them once, tokens ordered by term, with
the vocabulary; searches then read only what they need.  A query tree becomes a DataFrame of
key and score, composed of joins, unions and anti-joins.  Terms that a query names are filtered
before anything is grouped; prefixes, wildcards and patterns are looked up in the vocabulary.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Invalid
from ..sources.settled import settle

STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")
K1, B = 1.2, 0.75
PHRASE_BOOST = 1.5


@dataclass(frozen=True)
class Analyzer:
    """``kind``: standard, whitespace, simple or keyword."""

    kind: str = "standard"
    lower: bool = True
    min_length: int = 1
    stop_words: tuple[str, ...] = ()

    def tokens(self, text: Column) -> Column:
        """The kept tokens in order; a token's place counts kept ones only."""
        if self.kind == "keyword":
            return F.when(F.length(text) > 0, F.array(F.lower(text) if self.lower else text)).otherwise(F.array().cast("array<string>"))
        if self.kind == "whitespace":
            raw = F.split(text, r"\s+")
            raw = F.transform(raw, F.lower) if self.lower else raw
        elif self.kind == "simple":
            raw = F.transform(F.regexp_extract_all(text, F.lit(r"(\p{L}+)")), F.lower)
        elif self.kind == "standard":
            raw = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_\-']+)"))
            strip = lambda t: F.regexp_replace(t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
            raw = F.transform(raw, (lambda t: F.lower(strip(t))) if self.lower else strip)
        else:
            raise Invalid(f"no analyzer is called {self.kind}")
        stop = self.stop_words if self.kind == "standard" else ()
        keep = lambda t: (F.octet_length(t) >= max(1, self.min_length)) & (~t.isin(*stop) if stop else F.lit(True))
        return F.filter(raw, keep)


STANDARD = Analyzer(stop_words=STOP_WORDS, min_length=2)


@dataclass
class Index:
    """``tokens``: field, term, key, pos.  ``lengths``: field, key, dl.  ``documents``: key and stored fields."""

    name: str
    analyzer: Analyzer
    fields: tuple[str, ...]
    numeric: tuple[str, ...]
    documents: DataFrame
    tokens: DataFrame
    state: str = "Online"
    boosts: dict[str, float] = field(default_factory=dict)
    #: what ``stored`` wrote: lengths, field statistics and vocabulary
    kept: dict[str, DataFrame] = field(default_factory=dict)

    def stored(self) -> Index:
        """The index written out, its tokens in ranges of field and term."""
        tokens = settle(self.tokens.repartitionByRange("field", "term", "key").sortWithinPartitions("field", "term", "key", "pos"))
        out = replace(self, documents=settle(self.documents), tokens=tokens, kept={})
        kept = {"lengths": settle(out.lengths())}
        kept |= {"stats": settle(kept["lengths"].groupBy("field").agg(F.avg("dl").alias("avgdl"), F.count(F.lit(1)).alias("docs"))), "vocabulary": settle(out.vocabulary().repartitionByRange("field", "term"))}
        return replace(out, kept=kept)

    def lengths(self) -> DataFrame:
        """Of documents that have the field, even with no token in it."""
        if "lengths" in self.kept:
            return self.kept["lengths"]
        sizes = self.documents.select("key", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.when(F.col(f"`{f}`").isNotNull(), F.size(self.analyzer.tokens(text_of(self.documents, f)))).alias("dl")) for f in self.fields)).cast("array<struct<field:string,dl:int>>")).alias("x"))
        return sizes.select("x.field", "key", "x.dl").filter("dl IS NOT NULL")

    def field_stats(self) -> DataFrame:
        if "stats" in self.kept:
            return self.kept["stats"]
        return self.lengths().groupBy("field").agg(F.avg("dl").alias("avgdl"), F.count(F.lit(1)).alias("docs"))

    def vocabulary(self) -> DataFrame:
        if "vocabulary" in self.kept:
            return self.kept["vocabulary"]
        return self.tokens.groupBy("field", "term").agg(F.count_distinct("key").alias("df"))


def text_of(df: DataFrame, f: str) -> Column:
    """A field as text; arrays of strings are joined by spaces."""
    c, t = F.col(f), df.select(f).schema[0].dataType
    return F.concat_ws(" ", c) if isinstance(t, T.ArrayType) else c.cast("string")


def string_fields(schema: T.StructType, prefix: str = "") -> list[str]:
    """Fields that hold text, nested ones included."""
    out = []
    for f in schema.fields:
        t = f.dataType
        if isinstance(t, T.StringType) or (isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType)):
            out.append(prefix + f.name)
        elif isinstance(t, T.StructType):
            out += string_fields(t, f"{prefix}{f.name}.")
    return out


def build(df: DataFrame, key: str, fields: list[str] | None = None, analyzer: Analyzer = STANDARD, numeric: tuple[str, ...] = (), name: str = "index") -> Index:
    """Index the named fields, or all that hold text."""
    found = tuple(f for f in (fields or string_fields(df.schema)) if f != key)
    documents = df.withColumn("key", F.col(key).cast("string"))
    each = F.array(*(F.struct(F.lit(f).alias("field"), analyzer.tokens(text_of(documents, f)).alias("terms")) for f in found)).cast("array<struct<field:string,terms:array<string>>>")
    rows = documents.select("key", F.explode(each).alias("x")).select("key", "x.field", F.posexplode("x.terms").alias("pos", "term"))
    flat = documents.select("key", *(F.col(f).alias(f) for f in dict.fromkeys((*found, *numeric))))
    return Index(name, analyzer, found, numeric, flat, rows.select("field", "term", "key", "pos"))


def update(index: Index, changed: DataFrame, key: str, gone: DataFrame | None = None) -> Index:
    """The index after ``changed`` documents came in place of their former selves and ``gone`` keys left."""
    new = build(changed, key, list(index.fields), index.analyzer, index.numeric, index.name)
    keys = new.documents.select("key")
    keys = keys.union(gone.select("key")) if gone is not None else keys
    out = lambda df: df.join(keys, "key", "left_anti")
    return Index(index.name, index.analyzer, index.fields, index.numeric, out(index.documents).unionByName(new.documents), out(index.tokens).select("field", "term", "key", "pos").union(new.tokens), index.state)


def bm25(tf: Column, df: Column, n: Column, dl: Column, avgdl: Column) -> Column:
    idf = F.log((n - df + 0.5) / (df + 0.5) + 1)
    return idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / avgdl))


class Search:
    def __init__(self, index: Index):
        self.index, self.spark = index, index.documents.sparkSession
        if index.state != "Online":
            raise Invalid(f"index {index.name} is {index.state}")

    # -- scoring

    def _scored(self, postings: DataFrame) -> DataFrame:
        """(field, term, key, pos, ...) rows of some terms, all their postings, to (field, term, key, score)."""
        tf = postings.groupBy("field", "term", "key").agg(F.count(F.lit(1)).alias("tf"))
        df = tf.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
        n = self.index.documents.agg(F.count(F.lit(1)).alias("n"))
        lengths = self.index.lengths()
        stats = self.index.field_stats()
        # one row, and one for each field
        rows = tf.join(df, ["field", "term"]).join(lengths, ["field", "key"]).join(F.broadcast(stats), "field").join(F.broadcast(n))
        return rows.select("field", "term", "key", bm25(F.col("tf"), F.col("df"), F.col("n"), F.col("dl"), F.col("avgdl")).alias("score"))

    def _fields(self, name: str | None) -> tuple[str, ...]:
        if name in (None, "_all"):
            return self.index.fields
        return (name,)

    def _tokens(self, name: str | None) -> DataFrame:
        return self.index.tokens.filter(F.col("field").isin(*self._fields(name)))

    def _sum(self, scored: DataFrame) -> DataFrame:
        return scored.groupBy("key").agg(F.sum("score").alias("score"))

    def analyze(self, text: str) -> list[str]:
        one = self.spark.range(1).select(self.index.analyzer.tokens(F.lit(text)).alias("t")).first()
        return list(one["t"])

    # -- query tree

    def run(self, q: dict[str, Any]) -> DataFrame:
        """key and score of the matching documents."""
        make = getattr(self, f"q_{q.get('type')}", None)
        if make is None:
            raise Invalid(f"no query type {q.get('type')!r}")
        return make(q)

    def q_match(self, q: dict[str, Any]) -> DataFrame:
        terms = list(dict.fromkeys(self.analyze(q["text"] if "text" in q else q["query"])))
        if not terms:
            return self.q_match_none(q)
        name, fuzz = q.get("field"), int(q.get("fuzziness") or 0)
        tokens = self._tokens(name)
        if fuzz:
            words = self.spark.createDataFrame([(t,) for t in terms], "asked string")
            vocabulary = tokens.select("term").distinct()
            near = vocabulary.join(F.broadcast(words), F.levenshtein("term", "asked", fuzz) >= 0).filter(F.levenshtein("term", "asked", fuzz) <= fuzz)
            hits = self._scored(tokens.join(near.select("term").distinct(), "term", "left_semi")).join(near, "term")
        else:
            hits = self._scored(tokens.filter(F.col("term").isin(*terms))).withColumn("asked", F.col("term"))
        if str(q.get("operator", "or")).lower() == "and":
            whole = hits.groupBy("field", "key").agg(F.count_distinct("asked").alias("c"), F.sum("score").alias("score")).filter(F.col("c") == len(terms))
            return self._sum(whole)
        return self._sum(hits)

    def q_match_phrase(self, q: dict[str, Any]) -> DataFrame:
        terms = self.analyze(q["text"] if "text" in q else q["query"])
        if not terms:
            return self.q_match_none(q)
        tokens = self._tokens(q.get("field")).filter(F.col("term").isin(*terms))
        # a phrase begins where every term stands at its distance
        starts = [tokens.filter(F.col("term") == t).select("field", "key", (F.col("pos") - i).alias("at")).distinct() for i, t in enumerate(terms)]
        found = reduce(lambda a, b: a.join(b, ["field", "key", "at"], "left_semi"), starts).select("field", "key").distinct()
        scored = self._scored(tokens).join(found, ["field", "key"], "left_semi")
        weight = {t: terms.count(t) for t in terms}
        times = F.create_map(*(x for t, n in weight.items() for x in (F.lit(t), F.lit(n))))
        return self._sum(scored.select("key", (F.col("score") * times[F.col("term")] * PHRASE_BOOST).alias("score")))

    def _of_terms(self, name: str | None, cond: Column, named: bool = False) -> DataFrame:
        """Scores of the terms for which ``cond`` holds: named ones, or those of the vocabulary."""
        tokens = self._tokens(name)
        if named or "vocabulary" not in self.index.kept:
            return self._sum(self._scored(tokens.filter(cond)))
        return self._sum(self._scored(tokens.join(self.index.vocabulary().filter(cond).select("field", "term"), ["field", "term"], "left_semi")))

    def q_term(self, q: dict[str, Any]) -> DataFrame:
        return self._of_terms(q.get("field"), F.col("term") == (q["term"] if "term" in q else q["value"]), named=True)

    def q_prefix(self, q: dict[str, Any]) -> DataFrame:
        return self._of_terms(q.get("field"), F.col("term").startswith(str(q["prefix"] if "prefix" in q else q["value"]).lower()))

    def q_wildcard(self, q: dict[str, Any]) -> DataFrame:
        glob = str(q["pattern"] if "pattern" in q else q["value"]).lower()
        return self._of_terms(q.get("field"), F.col("term").rlike("^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob) + "$"))

    def q_regexp(self, q: dict[str, Any]) -> DataFrame:
        return self._of_terms(q.get("field"), F.col("term").rlike(f"^(?:{q['pattern'] if 'pattern' in q else q['value']})$"))

    def q_numeric_range(self, q: dict[str, Any]) -> DataFrame:
        if q["field"] not in self.index.numeric:
            return self.q_match_none(q)
        c, cond = F.col(q["field"]).cast("double"), F.lit(True)
        if q.get("min") is not None:
            cond = cond & (c >= q["min"] if q.get("inclusive_min", True) else c > q["min"])
        if q.get("max") is not None:
            cond = cond & (c <= q["max"] if q.get("inclusive_max", True) else c < q["max"])
        return self.index.documents.filter(cond).select("key", F.lit(1.0).alias("score"))

    def q_match_all(self, q: dict[str, Any]) -> DataFrame:
        return self.index.documents.select("key", F.lit(1.0).alias("score"))

    def q_match_none(self, q: dict[str, Any]) -> DataFrame:
        return self.index.documents.limit(0).select("key", F.lit(1.0).alias("score"))

    def q_bool(self, q: dict[str, Any]) -> DataFrame:
        must, should, never = ([self.run(x) for x in q.get(k) or []] for k in ("must", "should", "must_not"))
        some = self._sum(reduce(DataFrame.unionByName, should)) if should else None
        if must:
            rows = reduce(DataFrame.unionByName, [m.withColumn("m", F.lit(i)) for i, m in enumerate(must)])
            out = rows.groupBy("key").agg(F.count_distinct("m").alias("c"), F.sum("score").alias("score")).filter(F.col("c") == len(must)).select("key", "score")
            if some is not None:
                out = out.join(some.withColumnRenamed("score", "more"), "key", "left").select("key", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))
        elif some is not None:
            out = some
        else:
            return self.q_match_none(q)  # with exclusions alone there is nothing to exclude from
        for n in never:
            out = out.join(n, "key", "left_anti")
        return out

    # -- results

    def top(self, request: dict[str, Any]) -> DataFrame:
        """The page of a request: key, score, stored fields, and fragments if asked for."""
        hits = self.run(request["query"])
        some = hits.orderBy(F.desc("score"), F.asc("key")).offset(int(request.get("from") or 0)).limit(int(request.get("size") or 10))
        wanted = request.get("fields") or []
        out = F.broadcast(some).join(self.index.documents.select("key", *(F.col(f"`{f}`") for f in self.index.documents.columns if f != "key" and (f in wanted or request.get("highlight")))), "key")
        if request.get("highlight"):
            terms = self.highlight_terms(request["query"])
            out = out.withColumn("fragments", F.array_compact(F.flatten(F.array(*(fragments(text_of(out, f), terms) for f in self.index.fields)))))
            out = out.drop(*(f for f in self.index.fields if f not in wanted))
        return out.orderBy(F.desc("score"), F.asc("key"))

    def totals(self, query: dict[str, Any]) -> DataFrame:
        return self.run(query).agg(F.count(F.lit(1)).alias("total_hits"), F.coalesce(F.max("score"), F.lit(0.0)).alias("max_score"))

    def highlight_terms(self, q: dict[str, Any]) -> list[str]:
        kind = q.get("type")
        if kind in ("match", "match_phrase"):
            return self.analyze(q["text"] if "text" in q else q["query"])
        if kind == "bool":
            return [t for k in ("must", "should") for x in q.get(k) or [] for t in self.highlight_terms(x)]
        return [str(q.get("term") or q.get("value"))] if kind == "term" else []


def fragments(text: Column, terms: list[str], around: int = 5, most: int = 3) -> Column:
    """Up to ``most`` windows of words around matches, the match in <mark>."""
    words = F.split(F.trim(text), r"\s+")
    plain = lambda w: F.regexp_replace(F.lower(w), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    if not terms:
        return F.array().cast("array<string>")
    hit = lambda w: plain(w).isin(*terms)
    places = F.filter(F.transform(words, lambda w, i: F.when(hit(w), i)), lambda i: i.isNotNull())
    marked = F.transform(words, lambda w: F.when(hit(w), F.concat(F.lit("<mark>"), w, F.lit("</mark>"))).otherwise(w))

    def window(i: Column) -> Column:
        low = F.greatest(i - around, F.lit(0))
        body = F.array_join(F.slice(marked, low + 1, F.lit(2 * around)), " ")
        return F.concat(F.when(low > 0, "...").otherwise(""), body, F.when(low + 2 * around < F.size(words), "...").otherwise(""))

    return F.transform(F.slice(places, 1, most), window)
