"""N-gram Jaccard join by vertical partitioning.

All shingles stand in one global order: rare before frequent, by the count of a token's slot in a
table of fixed size, then by hash. Two sets with the wanted similarity share a token among the
first n - ceil(t n) + 1 of each. The order is cut into fragments.

1. Equal sets are one class; its smallest document stands for it.
2. Candidates. The leading tokens of each set go to their fragments. A fragment is read as a
   stream: the first set with a token becomes the token's pivot, later ones are noted with it. So
   a token of a third of all sets costs one row each, in no more memory than its first.
3. Each set is compared with the pivot it shares most tokens with; links make components.
4. What is left are tokens whose sets lie in several components. In rounds, each token takes pivots of
   some of its largest components, the sets that share most tokens with others, and sets of smaller
   components are compared with them, a few comparisons for each set and round. No pair is compared twice.
   Rounds go on while many sets link.
5. Pairs of sets across the components that remain are compared, so a large group of copies is never
   expanded into its pairs. No link that would join two components is missed.

Two sets meet in a token only if it could be their first common one: all they share then stands from
there on in both, so the shorter of the two rests has to reach the overlap that the threshold asks for.
Sets of a large group of near copies that differ by too many rare tokens of their own hold the tokens of
the group too far behind, and don't meet.

A pair is compared fragment by fragment: the sets are cut vertically, overlaps of a fragment are
counted on their own, pairs that can't reach the threshold any more are dropped after the first,
and the partial overlaps are summed. The order decides how much work there is, never the result.

Defined results: NULL and empty texts and texts without words have an empty set, link with
nothing and are their own component. Fewer words than a shingle are one shingle. Rows that
repeat an identifier share their links. A NULL identifier has a NULL component and takes no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType
from xxhash import xxh3_64_intdigest, xxh3_128_hexdigest

from stagecast.llm.common import fresh_dir, grouped_rows, mark, materialise, ready, release
from stagecast.llm.components import components
from stagecast.llm.shingles import SlotTable, shingle_set

#: Slots of the frequency table, four bits each: 64 MB, whatever the corpus. It is a stored table, read by tasks alone.
SLOT_BITS = 27
#: Leading tokens of one candidate fragment, and fragments into which a set is cut to be compared.
FRAGMENT_TOKENS = 500_000
FRAGMENTS = 8
#: A list of documents up to this length is sent to all tasks (16 MB); a longer one is joined.
SENT_IDS = 2_000_000
#: Rounds of comparisons with pivots go on while this share of the compared sets links, up to so many.
LINKING = 0.02
ROUNDS = 8
#: Pivots of a token in a round, each of another component.
PIVOTS = 8
PAIR = ["a", "a_n", "b", "b_n"]

def leading(n: int, num: int, den: int) -> int:
    """How many leading tokens of ``n`` one must look at: overlap is at least ceil(n num / den)."""
    return n - -(-n * num // den) + 1


def _levels(counts: np.ndarray) -> np.ndarray:
    """How many bits each count has, 15 at most, two levels in a byte."""
    level = np.minimum(np.frexp(counts.astype(np.float32))[1], 15).astype(np.uint8)
    return level[::2] << 4 | level[1::2]


def _level(packed: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    slot = tokens >> np.uint64(64 - SLOT_BITS)
    return packed[slot >> np.uint64(1)] >> (4 * (1 - (slot & np.uint64(1)))).astype(np.uint8) & 15


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """doc, n, digest of each document's set of shingles."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in grouped_rows(batches, ["doc", "text"]):
            sets = [shingle_set(t, n) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array([xxh3_128_hexdigest(s) for s in sets])],
                ["doc", "n", "digest"],
            )

    return docs.mapInArrow(digest, "doc long, n long, digest string")


@dataclass
class Chosen:
    """Rows (doc, text, ..) whose ``doc`` is, or is not, in a list that all tasks have."""

    rows: DataFrame
    known: Broadcast | None = None
    present: bool = True

    @property
    def sparkSession(self) -> SparkSession:  # noqa: N802  as a DataFrame has it
        return self.rows.sparkSession

    def mapInArrow(self, function: Callable, schema: str | StructType) -> DataFrame:  # noqa: N802
        """As of a DataFrame; rows are chosen in the same step."""
        known, present = self.known, self.present
        if known is None:
            return self.rows.mapInArrow(function, schema)

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                doc = batch.column("doc")
                wanted = (np.isin(doc.fill_null(0).to_numpy(), known.value) & doc.is_valid().to_numpy(zero_copy_only=False)) == present
                yield batch.filter(pa.array(wanted))

        return self.rows.mapInArrow(lambda batches: function(choose(batches)), schema)


def only(rows: DataFrame, ids: DataFrame, present: bool = True) -> Chosen:
    """Rows whose ``doc`` is (not) in the stored table ``ids``."""
    if ids.count() > SENT_IDS:
        return Chosen(rows.join(ids, "doc", "left_semi" if present else "left_anti"))
    known = np.sort(np.fromiter((r[0] for r in ids.toLocalIterator()), dtype=np.int64))
    return Chosen(rows, rows.sparkSession.sparkContext.broadcast(known), present)


def _postings(docs: Chosen, n: int, num: int, den: int, fragments: int, level: SlotTable) -> DataFrame:
    """Leading tokens with documents, set sizes and how many tokens of the set stand from there on, as arrays by fragment."""

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in grouped_rows(batches, ["doc", "text"]):
            tokens, owner, sizes, rests = [np.empty(0, np.uint64)], [], [], []
            for doc, text in zip(ids, texts):
                found = shingle_set(text, n)
                if len(found):
                    order = np.argsort(_level(level.read(), found), kind="stable")  # sets are sorted by hash
                    tokens.append(found[order[: leading(len(found), num, den)]])
                    owner.append(np.full(len(tokens[-1]), doc))
                    sizes.append(np.full(len(tokens[-1]), len(found)))
                    rests.append(len(found) - np.arange(len(tokens[-1])))
            token = np.concatenate(tokens)
            if len(token):
                doc, size, rest = np.concatenate(owner).astype(np.int64), np.concatenate(sizes).astype(np.int32), np.concatenate(rests).astype(np.int32)
                place = (token % np.uint64(fragments)).astype(np.int64)
                order = np.argsort(place, kind="stable")
                present, starts = np.unique(place[order], return_index=True)
                parts = np.split(order, starts[1:])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(present), *(pa.array([c[p].tobytes() for p in parts], pa.binary()) for c in (token, doc, size, rest))],
                    ["fragment", "tokens", "docs", "sizes", "rests"],
                )

    return docs.mapInArrow(lead, "fragment long, tokens binary, docs binary, sizes binary, rests binary")


def _shared(postings: DataFrame, fragments: int) -> DataFrame:
    """token, pivot, pivot_n, pivot_rest, doc, n, rest for every posting but the first of its token."""
    kinds = {"tokens": np.uint64, "docs": np.int64, "sizes": np.int32, "rests": np.int32}

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.empty(0, kind) for kind in kinds.values()]
        for batch in batches:
            if not batch.num_rows:
                continue
            more = (np.frombuffer(b"".join(batch.column(c).to_pylist()), kind) for c, kind in kinds.items())
            held = [np.concatenate(both) for both in zip(seen, more)]
            order = np.argsort(held[0], kind="stable")  # pivots come first among equal tokens
            token, doc, n, rest = (column[order] for column in held)
            new = np.r_[True, token[1:] != token[:-1]]
            later = ~new
            pivot = (np.flatnonzero(new)[np.cumsum(new) - 1])[later]
            seen = [column[new] for column in (token, doc, n, rest)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (token[later].view(np.int64), doc[pivot], n[pivot], rest[pivot], doc[later], n[later], rest[later])],
                ["token", "pivot", "pivot_n", "pivot_rest", "doc", "n", "rest"],
            )

    tasks = min(fragments, 4 * int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return postings.repartition(tasks, "fragment").mapInArrow(stream, "token long, pivot long, pivot_n int, pivot_rest int, doc long, n int, rest int")


def _meets(m: Column, m_rest: Column, n: Column, n_rest: Column, num: int, den: int) -> Column:
    """Whether sets of ``m`` and ``n`` tokens can have the similarity if this token is their first common one.

    In the global order all common tokens then stand from it on in both sets.
    """
    return F.least(m_rest, n_rest).cast("long") * (num + den) >= (m + n).cast("long") * num


def _segments(docs: Chosen, n: int) -> DataFrame:
    """doc, n, version, fragment, tokens: the sets cut vertically by ranges of hash; ``version`` tells texts of one identifier apart."""
    cuts = (np.arange(1, FRAGMENTS, dtype=np.uint64) << np.uint64(64 - FRAGMENTS.bit_length() + 1))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in grouped_rows(batches, ["doc", "text"]):
            rows = []
            for doc, text in zip(ids, texts):
                found = shingle_set(text, n)
                version = xxh3_64_intdigest(found) - (1 << 63)
                rows += [(doc, len(found), version, f, part.view(np.int64)) for f, part in enumerate(np.split(found, np.searchsorted(found, cuts)))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["doc", "n", "version", "fragment", "tokens"]
            )

    return docs.mapInArrow(cut, "doc long, n int, version long, fragment int, tokens array<long>")


def _links(pairs: DataFrame, segments: DataFrame, num: int, den: int) -> DataFrame:
    """Of the stored pairs (a, a_n, b, b_n), the linked ones: partial overlaps, summed."""
    begun = mark()
    compared = [*PAIR, "a_version", "b_version"]

    def overlaps(some: DataFrame, which: Column) -> DataFrame:
        side = lambda x: segments.where(which).withColumnsRenamed({"doc": x, "n": f"{x}_n", "version": f"{x}_version", "tokens": f"{x}_tokens"})
        keys = lambda x: [c for c in (x, f"{x}_n", f"{x}_version") if c in some.columns]
        shared = F.size(F.array_intersect("a_tokens", "b_tokens")).alias("shared")
        met = some.join(side("b"), keys("b")).join(side("a"), [*keys("a"), "fragment"])
        # Rows that repeat a document have its fragments again, which count once.
        return met.select(*compared, "fragment", shared, F.size("a_tokens").alias("x"), F.size("b_tokens").alias("y")).distinct()

    reach = lambda both: both * (num + den) >= (F.col("a_n") + F.col("b_n")) * num  # noqa: E731  den I >= num (a + b - I)
    first = overlaps(pairs, F.col("fragment") == 0).withColumn("rest", F.least(F.col("a_n") - F.col("x"), F.col("b_n") - F.col("y")))
    first = materialise(first.where(reach(F.col("shared") + F.col("rest"))).select(*compared, "shared"), "first-fragment")
    others = overlaps(first.drop("shared"), F.col("fragment") > 0).select(*compared, "shared")
    total = first.unionByName(others).groupBy(*compared).agg(F.sum("shared").alias("shared"))
    done = mark()
    links = materialise(total.where(reach(F.col("shared"))).select("a", "b").distinct(), "links")
    release(pairs.sparkSession, begun, done)
    return links


def similar_groups(
    docs: DataFrame, shingle_words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: id, n_shingles, component_id, for links of a similarity >= num / den."""
    spark = ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    sets = materialise(_sets(rows, shingle_words), "sets")
    classes = sets.where("n > 0 AND doc IS NOT NULL").groupBy("digest", "n").agg(F.min("doc").alias("rep"))
    member = materialise(sets.where("n > 0 AND doc IS NOT NULL").join(classes, ["digest", "n"]).select("doc", "n", "rep").distinct(), "members")
    # A document that stands for no class needs no comparison of its own.
    idle = materialise(sets.select("doc").where("doc IS NOT NULL").distinct().join(member.select(F.col("rep").alias("doc")), "doc", "left_anti"), "idle")
    rows = rows.where("doc IS NOT NULL")
    used = only(rows, idle, present=False)

    def tokens(batch: pa.RecordBatch) -> np.ndarray:
        return np.concatenate([np.empty(0, np.uint64), *(shingle_set(t, shingle_words) for t in batch.column("text").to_pylist())])

    level = SlotTable.of(used, tokens, SLOT_BITS, _levels, fresh_dir(spark, "levels"))
    total = member.where("doc = rep").agg(F.sum(F.col("n") - F.ceil(F.col("n") * num / den) + 1)).first()[0] or 0
    fragments = max(1, math.ceil(total / FRAGMENT_TOKENS))
    fragments = max(fragments, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shared = materialise(
        _shared(_postings(used, shingle_words, num, den, fragments, level), fragments).where("pivot <> doc"), "shared-tokens"
    )
    meets = _meets(F.col("pivot_n"), F.col("pivot_rest"), F.col("n"), F.col("rest"), num, den)
    counted = shared.groupBy("doc", "n", "pivot", "pivot_n").agg(F.count("*").alias("c"), F.max(meets).alias("meets")).where("meets")
    best = counted.groupBy("doc", "n").agg(F.max_by(F.struct("pivot", "pivot_n"), F.struct("c", -F.col("pivot"))).alias("p"))
    pairs = materialise(
        best.select(F.col("p.pivot").alias("a"), F.col("p.pivot_n").alias("a_n"), F.col("doc").alias("b"), F.col("n").alias("b_n")), "pairs"
    )
    compared = materialise(pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct(), "compared")
    begun = mark()
    segments = materialise(_segments(only(rows, compared), shingle_words), "segments")
    first_links = _links(pairs, segments, num, den)
    release(spark, begun, begun + 1)
    copies = member.where("doc <> rep").select(F.col("rep").alias("a"), F.col("doc").alias("b"))
    found = materialise(components(first_links.unionByName(copies)), "components")
    found = _joined(shared, found, pairs, rows, shingle_words, num, den)
    return sets.join(found, sets["doc"] == found["node"], "left").select(
        sets["doc"].alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id")
    )


def one_of_each_group(
    docs: DataFrame, shingle_words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``docs`` with the smallest identifier of each group; documents without words stay."""
    groups = similar_groups(docs, shingle_words, num, den, id_col, text_col)
    dropped = groups.where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).cast("long").alias("doc")).distinct()
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    kept = only(rows, materialise(dropped, "dropped"), present=False)
    return kept.mapInArrow(lambda batches: batches, rows.schema).select("_row.*")


def _mixed(holders: DataFrame, found: DataFrame, num: int, den: int) -> DataFrame:
    """token, doc, n, rest, c (its component) for tokens whose documents lie in several components.

    Sets that can't meet any other in the token are left out; its smallest set and those just similar in size ask for least.
    """
    rows = holders.join(found.select(F.col("node").alias("doc"), F.col("component").alias("c")), "doc", "left")
    rows = materialise(rows.select("token", "doc", "n", "rest", F.coalesce("c", "doc").alias("c")), "holders")
    several = rows.groupBy("token").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.min("n").alias("least")).where("x <> y").select("token", "least")
    least = F.greatest(F.col("least"), F.ceil(F.col("n") * num / den).cast("int"))
    rows = rows.join(several, "token").where(_meets(F.col("n"), F.col("rest"), least, F.col("rest"), num, den))
    return materialise(rows.drop("least"), "mixed")


def _largest(mixed: DataFrame) -> DataFrame:
    """token, top: the component with most documents of a token."""
    return mixed.groupBy("token", "c").agg(F.count("*").alias("k")).groupBy("token").agg(F.max_by("c", F.struct("k", "c")).alias("top"))


def _merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components of ``found`` (which has both ends of every link) joined by links."""
    named = lambda side: found.select(F.col("node").alias(side), F.col("component").alias(f"{side}_c"))
    between = links.join(named("a"), "a").join(named("b"), "b").select(F.col("a_c").alias("a"), F.col("b_c").alias("b"))
    new = components(between).select(F.col("node").alias("component"), F.col("component").alias("new"))
    return materialise(found.join(new, "component", "left").select("node", F.coalesce("new", "component").alias("component")), "components")


def _joined(shared: DataFrame, found: DataFrame, tried: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """``found`` with all links across its components; the pairs ``tried`` have been compared."""
    tried = _pairs(tried)
    holders = shared.select("token", "doc", "n", "rest").unionByName(
        shared.select("token", F.col("pivot").alias("doc"), F.col("pivot_n").alias("n"), F.col("pivot_rest").alias("rest"))
    ).distinct()
    mixed = _mixed(holders, found, num, den)
    weight = materialise(mixed.groupBy("doc").agg(F.count("*").alias("weight")), "weights")
    alone = weight.join(found.select(F.col("node").alias("doc")), "doc", "left_anti").select(F.col("doc").alias("node"), F.col("doc").alias("component"))
    found = materialise(found.unionByName(alone), "components")
    begun = mark()
    segments = materialise(_segments(only(docs, materialise(weight.select("doc"), "compared")), n), "segments")
    for k in range(ROUNDS):
        pairs = materialise(_with_pivots(mixed, weight, tried, k, num, den), "pairs")
        tried = tried.unionByName(pairs)
        links = _links(pairs, segments, num, den)
        n_pairs, n_links = pairs.count(), links.count()
        if n_links:
            found = _merged(found, links)
            mixed = _mixed(mixed.drop("c"), found, num, den)
        if n_links <= LINKING * n_pairs:
            break
    links = _links(materialise(_across(mixed, num, den).join(tried, PAIR, "left_anti"), "pairs"), segments, num, den)
    if not links.isEmpty():
        found = _merged(found, links)
    release(docs.sparkSession, begun, begun + 2)
    return found


def _pairs(rows: DataFrame) -> DataFrame:
    """The distinct pairs (a, a_n, b, b_n) of ``rows``, the smaller identifier first."""
    first, second = F.struct(F.col("a").alias("d"), F.col("a_n").alias("n")), F.struct(F.col("b").alias("d"), F.col("b_n").alias("n"))
    pairs = rows.select(F.least(first, second).alias("x"), F.greatest(first, second).alias("y")).distinct()
    return pairs.select(F.col("x.d").alias("a"), F.col("x.n").alias("a_n"), F.col("y.d").alias("b"), F.col("y.n").alias("b_n"))


def _with_pivots(mixed: DataFrame, weight: DataFrame, tried: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Pairs of documents with pivots of larger components of their tokens that were not ``tried``, at most ``PIVOTS`` for each document.

    The components of a token are dealt to places, anew in each round, and the largest of each place has a
    pivot: the document with most tokens in common with others, from the second round on one by chance.
    """
    size = mixed.groupBy("token", "c").agg(F.count("*").alias("size"))
    rows = mixed.join(weight, "doc").join(size, ["token", "c"]).withColumn("place", F.pmod(F.xxhash64("c", F.lit(k)), F.lit(PIVOTS)))
    first = F.xxhash64("doc", "token", F.lit(k)) if k else F.col("weight")
    pivot = F.struct(*[F.col(x).alias(f"a_{x}") for x in ("doc", "n", "rest", "size", "c")])
    pivots = rows.groupBy("token", "place").agg(F.max_by(pivot, F.struct("size", "c", first, -F.col("doc"))).alias("p"))
    met = rows.drop("place").join(pivots.select("token", "place", "p.*"), "token").where(
        ((F.col("size") < F.col("a_size")) | ((F.col("size") == F.col("a_size")) & (F.col("c") < F.col("a_c"))))
        & _meets(F.col("n"), F.col("rest"), F.col("a_n"), F.col("a_rest"), num, den)
    )
    both = tried.unionByName(tried.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    both = both.withColumnsRenamed({"a": "a_doc", "b": "doc", "b_n": "n"})
    counted = met.groupBy("doc", "n", "place", "a_doc", "a_n").agg(F.count("*").alias("shared")).join(both, ["doc", "n", "a_doc", "a_n"], "left_anti")
    best = counted.groupBy("doc", "n", "place").agg(F.max_by(F.struct("a_doc", "a_n"), F.struct("shared", -F.col("a_doc"))).alias("p"))
    return _pairs(best.select(F.col("p.a_doc").alias("a"), "p.a_n", F.col("doc").alias("b"), F.col("n").alias("b_n")))


def _across(mixed: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of documents that may be similar and aren't connected yet, by their first common tokens."""
    rows = mixed.join(_largest(mixed), "token")
    # The largest component of a token is met by the others and never by itself.
    named = lambda rows, side: rows.withColumnsRenamed({name: f"{side}_{name}" for name in ("n", "rest", "c")} | {"doc": side})
    left, right = named(rows.where("c <> top").drop("top"), "a"), named(rows, "b")
    met = left.join(right, "token").where(
        (F.col("a_c") != F.col("b_c")) & ((F.col("b_c") == F.col("top")) | (F.col("a_c") < F.col("b_c")))
        & _meets(F.col("a_n"), F.col("a_rest"), F.col("b_n"), F.col("b_rest"), num, den)
    )
    return _pairs(met)
