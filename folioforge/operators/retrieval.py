"""Search over a chunk table: BM25, cosine, fusion, boosts, diversification, context.

Every ranking has a total order: score, then id. Query terms and vectors are driver-side constants;
chunk tables are never collected.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from . import filters as flt
from . import tables
from .segments import MOST_SENT, Segments

K1, B, RRF_K = 1.2, 0.75, 60
COMMENT_BOOST, TAG_BOOST, INTEREST_BOOST = 1.2, 1.15, 0.15


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_terms(query: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))


def _is(term: str) -> Callable[[Column], Column]:
    return lambda x: x == term


def postings(chunks: DataFrame) -> DataFrame:
    """term, id, tf and the chunk's length: an index to store bucketed by term."""
    # a chunk's words are counted where its text is: texts are shuffled, which are shorter than their postings
    t = chunks.select("id", "text").repartition("id").select("id", tokens(F.col("text")).alias("t"))
    return t.select("id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl"))


def _weight(tf: Column, df: Column, n: Column, dl: Column, average: Column) -> Column:
    idf = F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))
    return F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))).otherwise(0.0)


def bm25(chunks: DataFrame, query: str, where: Column | None = None) -> DataFrame:
    """id and score of the chunks that hold a query term; statistics are of all chunks, `where` picks candidates.

    Only the query's terms are counted, in texts that hold them, so no token is exploded or shuffled: document
    frequencies and lengths come from one aggregation to a row. Where many queries are run, `TextIndex` is read instead.
    """
    terms = query_terms(query)
    if not terms:
        return chunks.select("id", F.lit(0.0).alias("score")).limit(0)
    low = F.lower("text")
    # a plain substring test first: few texts are searched for whole words
    tf = {t: F.when(low.contains(t), F.regexp_count(low, F.lit(rf"(?<![\p{{L}}\p{{N}}]){t}(?![\p{{L}}\p{{N}}])"))).otherwise(0) for t in terms}
    lengths = chunks.select(F.size(tokens(F.col("text"))).alias("__dl"), *[(tf[t] > 0).alias(f"__h{i}") for i, t in enumerate(terms)])
    stats = lengths.agg(F.count(F.lit(1)).alias("__n"), F.avg("__dl").alias("__avg"), *[F.count_if(f"__h{i}").alias(f"__df{i}") for i in range(len(terms))])
    hit = chunks.filter(where) if where is not None else chunks
    hit = hit.filter(reduce(or_, [low.contains(t) for t in terms]))
    hit = hit.select("id", F.size(tokens(F.col("text"))).alias("__dl"), *[tf[t].alias(f"__tf{i}") for i, t in enumerate(terms)])
    hit = hit.filter(reduce(or_, [F.col(f"__tf{i}") > 0 for i in range(len(terms))]))
    score = F.lit(0.0)
    for i in range(len(terms)):
        score = score + _weight(F.col(f"__tf{i}").cast("double"), F.col(f"__df{i}").cast("double"), F.col("__n"), F.col("__dl"), F.col("__avg"))
    return hit.crossJoin(F.broadcast(stats)).select("id", F.round(score, 6).alias("score"))  # stats is one row


#: Postings in a block, steps of impact that blocks of a term are sorted into, and ids that are written into a scan's filter.
BLOCK, STEPS, IN_FILTER = 1024, 16, 1000
NUMBERS = "chunks long, texts long, tokens long, buckets long"
#: Chunks for each bucket of an index that is made, which has MOST_BUCKETS at most.
PER_BUCKET, MOST_BUCKETS = 5_000, 256
#: Tasks that a bucket's rows are dealt over.
FILES = 4


class TextIndex:
    """A stored full-text index that a top-k search reads in part.

    Postings of a term are kept in blocks of about BLOCK, by falling impact (what they add to a score, but for the term's rarity):
    a block is a row with its ids, and its greatest frequency and least length, which bound what any of its postings adds at any
    average length. Beside them are each chunk's own terms, by id, document frequencies as sums of changes, and the corpus's
    size and tokens, one row. All three tables are `Segments` with the same batches, and the last to be written says which of them
    count: `add` and `drop` write what is new and name what is gone, in the buckets concerned, and `merge` puts batches together.

    `top` reads the blocks of highest impact first, which gives a k-th score at least, and from it how far each term's list has to
    be read so that no unread posting can matter; what is then a candidate is scored from its own terms. The result is that of a scan.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.blocks = Segments(spark, f"{path}/blocks", "bucket", "block_key", ["term", "step"])
        self.own = Segments(spark, f"{path}/own", "bucket")
        self.frequencies = Segments(spark, f"{path}/frequencies", "bucket", "term")
        self._numbers: tuple[int, tuple[int, ...]] | None = None

    @classmethod
    def build(cls, chunks: DataFrame, path: str) -> TextIndex:
        index = cls(chunks.sparkSession, path)
        index._change(chunks, None, whole=True)
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TextIndex:
        """The index that was stored there, in this session or another."""
        return cls(spark, path)

    def add(self, chunks: DataFrame) -> None:
        """New chunks beside those that are there, and changed ones in their place."""
        self._change(chunks, chunks.select("id"))

    def drop(self, ids: DataFrame) -> None:
        """Chunks (id) that are gone."""
        self._change(None, ids)

    def merge(self) -> None:
        """Batches put together: postings of what is gone are left out and blocks made anew."""
        live = self.own.live()
        if live is not None:
            live, batch, numbers = tables.settle(live.drop("batch")), self.own.state().last + 1, self.numbers()
            self._count(numbers, batch)
            self.blocks.merge(lambda _: self._in_blocks(self._postings(live, numbers[3]), self._average(numbers)), batch=batch)
            self.frequencies.merge(lambda d: d.groupBy("bucket", "term").agg(F.sum("n").alias("n")).filter("n <> 0"), batch=batch)
            self.own.merge(batch=batch)

    def _count(self, numbers: tuple[int, ...], batch: int) -> None:
        self.spark.createDataFrame([numbers], NUMBERS).write.mode("overwrite").parquet(f"{self.path}/numbers/batch={batch}")

    def numbers(self) -> tuple[int, ...]:
        """Chunks of the corpus, those that have a text, tokens, and the index's buckets."""
        last = self.own.state().last
        if self._numbers is None or self._numbers[0] != last:
            self._numbers = last, tuple(self.spark.read.parquet(f"{self.path}/numbers/batch={last}").first()) if last else (0, 0, 0, 1)
        return self._numbers[1]

    @staticmethod
    def _average(numbers: tuple[int, ...]) -> float:
        return numbers[2] / numbers[1] if numbers[1] else 1.0

    def _own(self, chunks: DataFrame, buckets: int) -> DataFrame:
        """id, dl, the terms with their frequencies, and a bucket of the id, of each chunk. Texts are dealt by bucket, and nothing else is shuffled."""
        key = ["bucket", "__file", "id"]
        dealt = chunks.select("id", "text", tables.bucket_of("id", buckets).alias("bucket"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(FILES)).alias("__file")).repartition("bucket", "__file")
        t = dealt.select(*key, tokens(F.col("text")).alias("t"))
        counted = t.select(*key, F.size("t").alias("dl"), F.explode_outer("t").alias("term")).groupBy(*key, "term").agg(F.count("term").cast("int").alias("tf"), F.max("dl").alias("dl"))
        held = F.map_from_entries(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf"))))  # the terms of one chunk
        return counted.groupBy(*key).agg(F.max("dl").alias("dl"), held.alias("terms")).select("id", "dl", "terms", "bucket")

    def _postings(self, own: DataFrame, buckets: int) -> DataFrame:
        return own.select("id", "dl", F.explode("terms").alias("term", "tf")).withColumn("bucket", tables.bucket_of("term", buckets))

    def _in_blocks(self, postings: DataFrame, average: float) -> DataFrame:
        """Blocks of postings: by bucket, term and step of impact; a step of many postings is dealt into several blocks, so that no list meets in a task."""
        impact = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(average)))
        stepped = postings.withColumn("step", F.floor(impact * STEPS).cast("int"))
        many = tables.settle(stepped.groupBy("term", "step").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")).filter("blocks > 1"))
        if many.count() <= MOST_SENT:  # a row for BLOCK postings
            many = F.broadcast(many)
        dealt = stepped.join(many, ["term", "step"], "left").withColumn("block", F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1)))).drop("blocks")
        dealt = dealt.withColumn("__file", F.pmod(F.xxhash64("term", "step", "block"), F.lit(FILES))).repartition("bucket", "__file")
        list_of = F.collect_list(F.struct("id", "tf", "dl"))
        made = dealt.groupBy("bucket", "__file", "term", "step", "block").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("most"), F.min("dl").alias("shortest"), list_of.alias("postings"))
        return made.withColumn("block_key", F.xxhash64("term", "step", "block")).drop("block", "__file")

    def _change(self, chunks: DataFrame | None, ids: DataFrame | None, whole: bool = False) -> None:
        numbers = self.numbers() if not whole else (0, 0, 0, max(1, min(MOST_BUCKETS, chunks.count() // PER_BUCKET)))
        buckets = numbers[3]
        batch, changes = self.own.state().last + 1, []
        # written once, and read again for the rest: it counts when the last table is written
        has = chunks is not None and self.own.put(self._own(chunks, buckets), batch)
        own = self.own.batch(batch) if has else None
        old = self._owned(ids) if ids is not None else None
        for d, sign in ((own, 1), (old, -1)):
            if d is not None:
                more = d.agg(F.count(F.lit(1)), F.count("dl"), F.coalesce(F.sum("dl"), F.lit(0))).first()
                numbers = (*(a + sign * b for a, b in zip(numbers[:3], more, strict=True)), buckets)
                changes.append(self._postings(d, buckets).select("bucket", "term", F.lit(sign).alias("n")))
        self._count(numbers, batch)
        self.frequencies.change(reduce(DataFrame.union, changes).groupBy("bucket", "term").agg(F.sum("n").alias("n")).filter("n <> 0") if changes else None, batch=batch, whole=whole)
        self.blocks.change(self._in_blocks(self._postings(own, buckets), self._average(numbers)) if own is not None else None, batch=batch, whole=whole, dealt=True)
        self.own.change(None, ids, batch=batch, whole=whole, written=has)

    def _owned(self, ids: DataFrame) -> DataFrame | None:
        """The stored rows of some ids; their buckets prune folders, and a few ids reach the scan."""
        stored = self.own.stored()
        if stored is None:
            return None
        ids = tables.settle(ids.select("id").distinct())
        buckets = sorted(r[0] for r in ids.select(tables.bucket_of("id", self.numbers()[3])).distinct().collect())  # MOST_BUCKETS at most
        stored = stored.filter(F.col("bucket").isin(buckets))
        few = ids.limit(IN_FILTER + 1).collect()
        if len(few) <= IN_FILTER:
            stored = stored.filter(F.col("id").isin([r["id"] for r in few]))
        return tables.settle(self.own.without_gone(stored).join(ids, "id", "left_semi").drop("batch"))

    def _blocks_of(self, terms: list[str]) -> DataFrame | None:
        stored = self.blocks.stored(self.own.state().last)
        if stored is None:
            return None
        wanted = self.spark.createDataFrame([(t,) for t in terms], "term string")
        buckets = [r[0] for r in wanted.select(tables.bucket_of("term", self.numbers()[3])).distinct().collect()]
        # the bucket prunes folders, the term reaches the scan
        return stored.filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms))

    def _rarity(self, terms: list[str]) -> dict[str, float]:
        """The number of chunks that hold each term."""
        rows = self.frequencies.stored(self.own.state().last)
        wanted = self.spark.createDataFrame([(t,) for t in terms], "term string")
        buckets = [r[0] for r in wanted.select(tables.bucket_of("term", self.numbers()[3])).distinct().collect()]
        found = rows.filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms)).groupBy("term").agg(F.sum("n").alias("n")).collect()
        return {r["term"]: float(r["n"]) for r in found if r["n"] > 0}

    def _read(self, blocks: DataFrame, among: DataFrame | None) -> DataFrame:
        """term, id, tf and dl of the postings in blocks that are still there."""
        rows = self.own.without_gone(blocks.select("term", "batch", F.inline("postings")))
        return rows.join(among.select("id"), "id", "left_semi") if among is not None else rows

    def _weights(self, df: dict[str, float], terms: list[str]) -> Callable[[int, Column, Column], Column]:
        n, average = F.lit(float(self.numbers()[0])), F.lit(self._average(self.numbers()))
        return lambda i, tf, dl: _weight(tf.cast("double"), F.lit(df.get(terms[i], 0.0)), n, dl, average)

    def _scored(self, postings: DataFrame, terms: list[str], weight: Callable[[int, Column, Column], Column]) -> DataFrame:
        """id and score: the terms' parts added in the query's order, so that scores are the same to the last digit."""
        tf = [F.max(F.when(F.col("term") == t, F.col("tf"))).alias(f"__tf{i}") for i, t in enumerate(terms)]
        rows = postings.groupBy("id").agg(F.max("dl").alias("dl"), *tf)
        return rows.select("id", F.round(sum((weight(i, F.coalesce(f"__tf{i}", F.lit(0)), F.col("dl")) for i in range(len(terms))), F.lit(0.0)), 6).alias("score"))

    def bm25(self, query: str, among: DataFrame | None = None) -> DataFrame:
        """id and score of all chunks that hold a query term, as `bm25` gives them; `among` (id) picks candidates."""
        terms, blocks = query_terms(query), None
        if terms:
            blocks = self._blocks_of(terms)
        if blocks is None:
            return self.own.stored().select("id", F.lit(0.0).alias("score")).limit(0) if self.own.stored() is not None else self.spark.createDataFrame([], "id long, score double")
        return self._scored(self._read(blocks, among), terms, self._weights(self._rarity(terms), terms))

    def steps(self, blocks: DataFrame, terms: list[str], df: dict[str, float]) -> dict[str, list[tuple[int, int, float]]]:
        """For each term its steps from the highest: step, postings, and a bound on what one of them adds. No posting is read."""
        weight = self._weights(df, terms)
        bound = F.coalesce(*[F.when(F.col("term") == t, weight(i, F.col("most"), F.col("shortest"))) for i, t in enumerate(terms)])
        rows = blocks.groupBy("term", "step").agg(F.sum("n").alias("n"), F.max(bound).alias("bound")).collect()  # STEPS * (K1 + 1) a term at most
        out: dict[str, list[tuple[int, int, float]]] = {}
        for r in sorted(rows, key=lambda r: -r["step"]):
            out.setdefault(r["term"], []).append((r["step"], r["n"], r["bound"]))
        return out

    def top(self, query: str, k: int, among: DataFrame | None = None) -> DataFrame:
        """id, score and rank of the k best: those of `bm25`, without reading blocks that can't hold one."""
        terms = query_terms(query)
        blocks = self._blocks_of(terms) if terms else None
        if blocks is None:
            return ranked(self.bm25(query, among), k)
        df = self._rarity(terms)
        steps, weight = self.steps(blocks, terms, df), self._weights(df, terms)
        # the first steps of each list, of a few times k postings: the k-th of their scores, as far as they are known, is one that counts
        least: dict[str, int] = {}
        for t, own in steps.items():
            held = 0
            for step, n, _ in own:
                if held < 4 * k:
                    least[t], held = step, held + n
        at_least = lambda cut: reduce(or_, [(F.col("term") == t) & (F.col("step") >= s) for t, s in cut.items()], F.lit(False))
        first = ranked(self._scored(self._read(blocks.filter(at_least(least)), among), terms, weight), k).select("score").collect()
        floor = min(r["score"] for r in first) - 2e-6 if len(first) == k else 0.0  # scores are rounded
        # lists are cut from below, the longest first, while all that is unread of them together stays under it
        cut, unread = {t: own[-1][0] for t, own in steps.items()}, dict.fromkeys(steps, 0.0)
        for t in sorted(steps, key=lambda t: -sum(n for _, n, _ in steps[t])):
            best = 0.0
            for j in range(len(steps[t]) - 1, -1, -1):
                best = max(best, steps[t][j][2])
                if sum(v for o, v in unread.items() if o != t) + best >= floor:
                    break
                unread[t] = best
                cut[t] = steps[t][j - 1][0] if j else steps[t][0][0] + 1
        seen = self._read(blocks.filter(at_least(cut)), among)
        if not any(unread.values()):
            return ranked(self._scored(seen, terms, weight), k)
        # what is read, and at most what is unread of the other lists
        partly = seen.groupBy("id").agg(*[F.max(F.when(F.col("term") == t, weight(i, F.col("tf"), F.col("dl")))).alias(f"__w{i}") for i, t in enumerate(terms)])
        most = sum((F.coalesce(f"__w{i}", F.lit(unread.get(t, 0.0))) for i, t in enumerate(terms)), F.lit(0.0))
        ids = partly.filter(most >= floor).select("id")
        own = self._owned(ids)
        full = own.select("id", "dl", F.explode("terms").alias("term", "tf")).filter(F.col("term").isin(terms))
        return ranked(self._scored(full, terms, weight), k)


def cosine(vector: Column, query: Sequence[float]) -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = sum(float(x) ** 2 for x in query) ** 0.5
    return dot(vector, q) / (F.sqrt(dot(vector, vector)) * F.lit(norm or 1.0))


def vector_search(vectors: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """id, score and rank of the k nearest by cosine; filter `vectors` beforehand."""
    return ranked(vectors.select("id", F.round(cosine(F.col("vector"), query), 6).alias("score")), k)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The k best by score and id, with their rank from 1. Sorting is a top-k; only k rows meet in one task."""
    best = scored.orderBy(F.desc("score"), "id").limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id")))


def fuse(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists."""
    part = lambda c: F.coalesce(F.lit(1.0) / (RRF_K + F.col(c)), F.lit(0.0))
    both = a.select("id", F.col("rank").alias("r1")).join(b.select("id", F.col("rank").alias("r2")), "id", "full_outer")
    return ranked(both.select("id", F.round(part("r1") + part("r2"), 6).alias("score")), k)


#: Finds the k nearest (id, score, rank), among some ids if they are given.
Nearest = Callable[[Sequence[float], int, DataFrame | None], DataFrame]


def _near(vectors: DataFrame | Nearest, vector: Sequence[float], k: int, own: DataFrame | None) -> DataFrame:
    if callable(vectors):
        return vectors(vector, k, own)
    return vector_search(vectors.join(own, "id", "left_semi") if own is not None else vectors, vector, k)


def _said(chunks: DataFrame, query: str, where: Column | None, index: TextIndex | None, k: int) -> DataFrame:
    """id, score and rank of the k best by words."""
    if index is None:
        return ranked(bm25(chunks, query, where), k)
    return index.top(query, k, chunks.filter(where).select("id") if where is not None else None)


def hybrid(chunks: DataFrame, vectors: DataFrame | Nearest, query: str, vector: Sequence[float], k: int, where: Column | None = None, index: TextIndex | None = None) -> DataFrame:
    """Nearest by vector and best by words, fused. vectors is a table or the search of a stored index; `index` a stored text index."""
    near = _near(vectors, vector, k, chunks.filter(where).select("id") if where is not None else chunks.select("id"))
    return fuse(near, _said(chunks, query, where, index, k), k)


def boost(results: DataFrame, query: str) -> DataFrame:
    """Comments and tag matches weigh more; ranks anew. Needs chunk_type and tags."""
    own = F.array(*[F.lit(t) for t in (query.lower().split() or [""])])
    tags = F.transform(F.split(F.lower(F.col("tags")), ", "), lambda x: F.trim(x))
    score = F.col("score") * F.when(F.col("chunk_type") == flt.COMMENT, COMMENT_BOOST).otherwise(1.0) * F.when(F.arrays_overlap(tags, own), TAG_BOOST).otherwise(1.0)
    return rerank_by(results.withColumn("score", F.round(score, 6)), "score")


def rerank_by(results: DataFrame, column: str) -> DataFrame:
    """Ranks from 1 by a column of a bounded result list."""
    return results.withColumn("rank", F.row_number().over(W.orderBy(F.desc(column), "id")))


def diversify(results: DataFrame, per_book: int, k: int) -> DataFrame:
    """At most per_book rows of each book, in rank order, k in all, ranked anew."""
    w = W.partitionBy("book_id").orderBy("rank", "id")
    kept = results.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= per_book).drop("__n").orderBy("rank", "id").limit(k)
    return kept.withColumn("rank", F.row_number().over(W.orderBy("rank", "id")))


def exact_phrase(chunks: DataFrame, phrase: str, k: int) -> DataFrame:
    """Chunks that hold the phrase, by how often."""
    n = T.occurrences(F.col("text"), phrase)
    hit = chunks.withColumn("score", n.cast("double")).filter("score > 0")
    return ranked(hit.select("id", "score"), k).withColumn("similarity", F.least(F.col("score") / 10, F.lit(1.0)))


def interest_boost(results: DataFrame, keywords: Sequence[str], factor: float = INTEREST_BOOST, include_tags: bool = True) -> DataFrame:
    """score (or rerank_score where there is one) times 1 + factor for each keyword in text (or tags); ranks anew."""
    if not keywords:
        return results
    n = T.keyword_matches(F.concat_ws(" ", "text", *["tags"] * include_tags), keywords)
    out = results
    governing = "score"
    if "rerank_score" in results.columns:
        out = out.withColumn("rerank_score", F.round(F.col("rerank_score") * (1 + factor * n), 6)).withColumn("score", F.when(F.col("rerank_score").isNull(), F.round(F.col("score") * (1 + factor * n), 6)).otherwise(F.col("score")))
        out = out.withColumn("__g", F.coalesce("rerank_score", "score"))
        return rerank_by(out, "__g").drop("__g")
    return rerank_by(out.withColumn("score", F.round(F.col("score") * (1 + factor * n), 6)), governing)


def merge_sources(results: DataFrame, k: int, order: str = "source") -> DataFrame:
    """One ranking of several sources' lists: by rerank_score if every row has one, else by rank within the source."""
    rrf = F.lit(1.0) / (RRF_K + F.col("rank"))
    if "rerank_score" in results.columns:
        every = results.agg(F.bool_and(F.col("rerank_score").isNotNull()).alias("__all"))
        results = results.crossJoin(F.broadcast(every)).withColumn("__m", F.when(F.col("__all"), F.col("rerank_score")).otherwise(rrf)).drop("__all")
    else:
        results = results.withColumn("__m", rrf)
    best = results.orderBy(F.desc("__m"), order, "rank", "id").limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("__m"), order, "rank", "id"))).drop("__m")


def expand_context(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """context: the parent's text, else a longer stored window, else the chunk's own."""
    parent = chunks.select(F.col("id").alias("__pid"), F.col("text").alias("__ptext"))
    out = results.join(parent, results["parent_id"] == F.col("__pid"), "left")
    window = F.col("window_text") if "window_text" in results.columns else F.lit(None).cast("string")
    longer = F.when(F.length(window) > F.length("text"), window)
    return out.withColumn("context", F.coalesce(F.nullif("__ptext", F.lit("")), longer, F.col("text"))).drop("__pid", "__ptext")


def search(chunks: DataFrame, vectors: DataFrame | Nearest | None, query: str, vector: Sequence[float] | None = None, k: int = 10, mode: str = "hybrid", where: Column | None = None, tags: Sequence[str] = (), per_book: int = 2, least_similarity: float = 0.0, languages: Sequence[str] = (), phrase: bool = False, index: TextIndex | None = None) -> DataFrame:
    """The whole query: stop words, oversampling, mode, boosts, length, tags, diversification, similarity."""
    clean, _ = T.clean_query(query, *languages)
    many = k * 5 if per_book < 999 else k
    own = chunks.filter(where) if where is not None else chunks
    if phrase:
        found = exact_phrase(own, query, many)
    elif mode == "keyword" or vectors is None or vector is None:
        found = _said(chunks, clean, where, index, many)
    elif mode == "semantic":
        found = _near(vectors, vector, many, own.select("id"))
    else:
        found = hybrid(chunks, vectors, clean, vector, many, where, index)
    rows = found.join(chunks, "id")
    if mode == "hybrid" and not phrase:
        rows = boost(rows, clean)
    rows = rows.filter(flt.long_enough(F.col("text")) & flt.has_all_tags(F.col("tags"), tags))
    rows = diversify(rows, per_book, k) if per_book < 999 else rows.orderBy("rank", "id").limit(k)
    if mode == "semantic":
        rows = flt.min_similarity(rows.withColumn("similarity", F.col("score")), least_similarity, mode)
    return rows.withColumn("score_type", F.lit("phrase" if phrase else mode))


def rerank(results: DataFrame, query: str, k: int, scorer: Callable[[Column, str], Column] | None = None) -> DataFrame:
    """rerank_score of each row by a pluggable scorer, and ranks by it; without a scorer, the share of query terms in the text."""
    terms = query_terms(query)
    share = scorer(F.col("text"), query) if scorer else F.size(F.array_intersect(tokens(F.col("text")), F.array(*[F.lit(t) for t in terms]))) / F.lit(float(max(len(terms), 1)))
    best = results.withColumn("rerank_score", F.round(share, 6)).orderBy(F.desc("rerank_score"), "rank", "id").limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("rerank_score"), "rank", "id")))


def service_search(chunks: DataFrame, vectors: DataFrame | Nearest, query: str, vector: Sequence[float], k: int = 10, per_book: int = 2, least_rerank: float = 0.0, scorer=None, index: TextIndex | None = None) -> DataFrame:
    """Thirty candidates or 3k undiversified, reranked to 3k, diversified to k, bounded by rerank score."""
    found = search(chunks, vectors, query, vector, max(30, 3 * k), per_book=999, index=index)
    return flt.min_rerank(diversify(rerank(found, query, 3 * k, scorer), per_book, k), least_rerank)


def prompt_rows(results: DataFrame) -> DataFrame:
    """rank, document (an XML element with escaped metadata), tokens (words)."""
    doc = F.concat(F.lit('<document index="'), F.col("rank").cast("string"), F.lit('" title="'), T.escape_xml(F.coalesce(F.col("book_id").cast("string"), F.lit(""))), F.lit('" page="'), T.escape_xml(F.coalesce(F.col("citation"), F.lit(""))), F.lit('">'), T.escape_xml(F.col("context")), F.lit("</document>"))
    return results.select("rank", doc.alias("document"), T.word_count(F.col("context")).alias("tokens"))


def prompt(results: DataFrame, question: str) -> DataFrame:
    """One row: the documents in rank order and the question. results is a bounded list."""
    parts = prompt_rows(results).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "document"))), lambda x: x["document"]), "\n").alias("d"), F.sum("tokens").alias("tokens"))
    return parts.select(F.concat(F.lit("<documents>\n"), F.col("d"), F.lit("\n</documents>\n\n" + question)).alias("prompt"), "tokens")


def search_text(rows: DataFrame, query: str, case_sensitive: bool = False) -> DataFrame:
    """Annotations whose text or note contains the query."""
    hay = F.concat_ws(" ", "highlight", "note")
    return rows.filter(hay.contains(query) if case_sensitive else F.lower(hay).contains(query.lower()))
