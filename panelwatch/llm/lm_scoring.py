"""Language-model scores of whole texts: a unigram base over words and a self-attention model over subwords."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwatch.llm import attention
from panelwatch.llm.hashing import words
from panelwatch.llm.subwords import Subwords, default_path
from panelwatch.llm.tables import encoded, in_chunks
from panelwatch.session import staged

_MOST_SHARED = 300_000  # words whose counts go to every task; the others are joined
_SUBWORD_BYTES = 1 << 22
_FLUSH_WORDS = 1_500_000


def _batches(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n``: fingerprints of all words of the learning rows with their counts, added up per task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.empty(0, np.int64), np.empty(0, np.int64))
        parts: list[np.ndarray] = []
        size = 0
        for batch in batches:
            texts = encoded(batch.column(0))
            for first, last in in_chunks(texts):
                parts.append(words(texts[first:last])[0])
                size += len(parts[-1])
                if size > _FLUSH_WORDS:
                    held, parts, size = _added(held, _counted(parts)), [], 0
                    if len(held[0]) > _FLUSH_WORDS:
                        yield _batches(["word", "n"], *held)
                        held = (held[0][:0], held[1][:0])
        if size:
            held = _added(held, _counted(parts))
        if len(held[0]):
            yield _batches(["word", "n"], *held)

    found = docs.filter("not held_out").select("text").mapInArrow(count, "word long, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _counted(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    word, n = np.unique(np.concatenate(parts), return_counts=True)
    return word.view(np.int64), n.astype(np.int64)


def _added(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The counts of both, each word once."""
    if not len(a[0]):
        return b
    word, of = np.unique(np.concatenate((a[0], b[0])), return_inverse=True)
    n = np.zeros(len(word), np.int64)
    for (w, m), at in zip((a, b), np.split(of, [len(a[0])])):
        n[at] += m  # words of one side are distinct
    return word, n


def base_scores(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """``row, n_tokens, n_known, train_tokens, base_score``, one row per distinct row.

    Counts of frequent words go to every task, at most ``_MOST_SHARED`` of them; the rarer words of the texts are joined
    with theirs, so no count has to fit into one place and no frequent word is shuffled.
    """
    spark = docs.sparkSession
    n_docs = docs.filter("not held_out").count()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    train, distinct = total[0] + n_docs, total[1] + (n_docs > 0)
    least, room = None, _MOST_SHARED
    for n, w in sorted(((r[0], r[1]) for r in counts.groupBy("n").count().collect()), reverse=True):
        if w > room:
            break
        least, room = n, room - w
    frequent = counts.filter(F.col("n") >= least).toPandas().sort_values("word") if least is not None else None
    shared = spark.sparkContext.broadcast(
        (frequent["word"].to_numpy(np.int64), frequent["n"].to_numpy(np.int64)) if frequent is not None else (np.empty(0, np.int64),) * 2
    )

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = shared.value
        logs = np.log10(n + 1.0)
        names = ["row", "word", "times", "known", "total"]
        for batch in batches:
            rows, texts = batch.column(0).to_numpy(), encoded(batch.column(1))
            for first, last in in_chunks(texts):
                word, bounds = words(texts[first:last])
                word = word.view(np.int64)
                owner = np.repeat(np.arange(last - first), np.diff(bounds))
                distinct, of = np.unique(word, return_inverse=True)  # sorted words are looked up much faster
                at = np.minimum(np.searchsorted(known, distinct), max(0, len(known) - 1))
                found = known[at] == distinct if len(known) else np.zeros(len(distinct), dtype=bool)
                hit = found[of]
                size = last - first
                sums = np.bincount(owner[hit], logs[at][of[hit]] if len(known) else None, size) if hit.any() else np.zeros(size)
                some = np.bincount(owner[hit], minlength=size)
                yield _batches(names, rows[first:last], pa.nulls(size, pa.int64()), np.diff(bounds) + 1, some, sums)
                rest = int((~hit).sum())
                if rest:
                    yield _batches(names, rows[first:last][owner[~hit]], word[~hit], np.zeros(rest, np.int64), np.zeros(rest, np.int64), np.zeros(rest))

    found = staged(docs.select("row", "text").mapInArrow(looked_up, "row long, word long, times long, known long, total double"))
    rare = counts.filter(F.col("n") < least) if least is not None else counts
    per_text = found.filter("word is null").select("row", F.lit(1).alias("rows"), "times", "known", "total")
    joined = found.filter("word is not null").select("row", "word").join(rare, "word").select(
        "row", F.lit(0).alias("rows"), F.lit(0).cast("long").alias("times"), F.lit(1).cast("long").alias("known"), F.log10(F.col("n") + 1.0).alias("total")
    )
    end = float(np.log10(n_docs + 1.0))
    sums = per_text.unionByName(joined).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("rows", "times", "known", "total")])
    each = lambda c: F.col(c) / F.col("rows")  # noqa: E731  copies of a row add up to a multiple
    return sums.select(
        "row",
        each("times").cast("long").alias("n_tokens"),
        (each("known") + int(n_docs > 0)).cast("long").alias("n_known"),
        F.lit(train).cast("long").alias("train_tokens"),
        (each("total") + end - each("times") * float(np.log10(train + distinct + 1.0))).alias("base_score"),
    )


def subword_rows(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, row, held_out, ids``: two bytes for each subword id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Subwords.at(tokenizer)
        for batch in batches:
            texts, out = encoded(batch.column("text")), []
            for first, last in in_chunks(texts, _SUBWORD_BYTES):
                ids, bounds = encoder.encode(texts[first:last])
                raw = ids.astype("<u2").tobytes()
                out += [raw[2 * bounds[i] : 2 * bounds[i + 1]] for i in range(last - first)]
            yield _batches(["doc_id", "row", "held_out", "ids"], *(batch.column(c) for c in ("doc_id", "row", "held_out")), pa.array(out, pa.binary()))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(cut, f"doc_id {kind}, row long, held_out boolean, ids binary")


def _ids(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype="<u2").astype(np.int64) for x in column.to_pylist()]


def _sums(rows: DataFrame, size: int, add) -> np.ndarray:
    """The sum over all rows of ``add(total, ids)``: vectors of ``size`` numbers, added up per task and then by Spark."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            add(total, _ids(batch.column(0)))
        used = np.flatnonzero(total)
        yield _batches(["place", "n"], used, total[used])

    found = rows.select("ids").mapInArrow(summed, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size)
    for r in found:
        out[r["place"]] = r["n"]
    return out


def in_turn(owner: np.ndarray, texts: int, turn: int, rounds: int) -> np.ndarray:
    """Which windows, given each one's text, are learned from in a round: over all rounds every window of every text once."""
    first = np.searchsorted(owner, np.arange(texts))
    return (np.arange(len(owner)) - first[owner] + owner + turn) % rounds == 0


def fit_attention(rows: DataFrame, tokenizer: str, rounds: int = 2) -> tuple[dict[str, np.ndarray], attention.Classes]:
    """The model learned from ``rows``, and the classes of the ids.

    Class shares and class pairs are counted over all rows. Attention is learned in ``rounds``: each task starts from the
    same parameters and learns on its share of the windows of its texts (another one each round, all of them over the
    rounds), and the results are averaged by the number of predictions, so work grows with the input and what is gathered
    per task does not.
    """
    from tokenizers import Tokenizer

    names = Tokenizer.from_file(tokenizer)
    look = attention.looks([names.id_to_token(i) or "" for i in range(attention.END + 1)])

    def one(total, texts):
        total += np.bincount(np.concatenate([*texts, np.full(len(texts), attention.END)]), minlength=len(total))

    classes = attention.Classes.from_counts(_sums(rows, attention.END + 1, one), look)
    shared_of = rows.sparkSession.sparkContext.broadcast(classes.of)

    def two(total, texts):
        of, end = shared_of.value, [attention.END]
        line = np.concatenate([end, *[x for t in texts for x in (t, end)]]).astype(np.int64)
        c = of[line].astype(np.int64)
        total += np.bincount(c[:-1] * attention.CLASSES + c[1:], minlength=len(total))

    pairs = _sums(rows, attention.CLASSES**2, two).reshape(attention.CLASSES, attention.CLASSES)
    model = attention.start_model(pairs)
    for turn in range(rounds):
        start = rows.sparkSession.sparkContext.broadcast(model)

        def learn(batches: Iterator[pa.RecordBatch], turn=turn, start=start) -> Iterator[pa.RecordBatch]:
            learner, of = attention.Learner(start.value), shared_of.value
            for batch in batches:
                texts = _ids(batch.column(0))
                for s in range(0, len(texts), 512):
                    part = texts[s : s + 512]
                    u, y, ok, _ = attention.windows(part, of, lambda owner, n=len(part), turn=turn: in_turn(owner, n, turn, rounds))
                    learner.learn(u, of[y].astype(np.int64), ok)
            flat = attention.packed(learner.model).astype(np.float64) * learner.seen
            if learner.seen:
                yield _batches(["place", "value", "weight"], np.arange(len(flat)), flat, np.full(len(flat), float(learner.seen)))

        mean = rows.select("ids").mapInArrow(learn, "place long, value double, weight double").groupBy("place").agg(
            (F.sum("value") / F.sum("weight")).alias("value")
        ).toPandas().sort_values("place")
        if len(mean):
            model |= attention.unpacked(mean["value"].to_numpy())
    return model, classes


def score_texts(
    df: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, rounds: int = 2
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, one row per row of ``df``.

    ``held_out`` is a condition on ``doc_id``; only the other rows are learned from. Words are lower-cased (A-Z), parted by
    white space, and followed by one end. ``score`` is the log10 probability of the subword ids of the text and its end.
    Null texts count as empty and are scored by their end alone; repeated rows get equal scores and count each.
    """
    path = tokenizer or default_path()
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    docs = df.select(F.col(f"`{key}`").alias("doc_id"), whole.alias("text")).select(
        "doc_id", "text", F.xxhash64("doc_id", "text").alias("row"), F.coalesce(held_out, F.lit(False)).alias("held_out")
    )
    base = base_scores(docs, staged(word_counts(docs)))
    rows = staged(subword_rows(docs, path))
    model, classes = fit_attention(rows.filter("not held_out"), path, rounds)
    shared = df.sparkSession.sparkContext.broadcast((model, classes.of, classes.log_share))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned, *parts = shared.value
        shares = attention.Classes(*parts)
        for batch in batches:
            texts = _ids(batch.column("ids"))
            score = [attention.log_probability(learned, shares, texts[s : s + 256]) for s in range(0, len(texts), 256)]
            yield _batches(["doc_id", "row", "held_out", "score"], *(batch.column(c) for c in ("doc_id", "row", "held_out")), np.concatenate(score))

    kind = docs.schema["doc_id"].dataType.simpleString()
    scores = rows.mapInArrow(scored, f"doc_id {kind}, row long, held_out boolean, score double")
    return scores.join(base, "row").select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
