"""Personal data by bootstrapped contextual extraction, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwatch.llm.tables import unused
from panelwatch.session import staged

KINDS = ("email", "ip", "card", "phone")

# Leftmost, non-overlapping matches. A run of characters that can start a match is entered only at its beginning or
# where the match before ended: from its other places the outcome is the same, and trying them all would take quadratic
# time. Possessive repetition keeps the stack flat on very long runs.
_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NEEDS = {"email": "@", "ip": r"\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
_IN_TOKEN = r"""[^\s,;"'()<>\[\]=]"""
_TOKEN = rf"""(?<!{_IN_TOKEN})(?:(?![0-9@]){_IN_TOKEN})*+[0-9@]{_IN_TOKEN}*+"""
_PLACED = "array<struct<value:string,start:int,before:string>>"
_SPANS = "array<struct<kind:int,start:int,end:int>>"
_TOKENS = "array<struct<token:string,start:int,end:int,left:string>>"
_LONG_WORD, _CHUNK = 40, 64


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 0, d).when(d >= 5, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(
            F.transform(F.split(match, r"\."), lambda p: F.ltrim(p, F.lit("0"))),
            lambda p: F.when(F.length(p) <= 3, F.coalesce(F.try_to_number(p, F.lit("999")), F.lit(0)) <= 255).otherwise(False),
        )
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where it is used inside other lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def _chunks(items: Column, size: int = _CHUNK) -> Column:
    """``items`` (a lambda variable) in pieces, so that work for each item does not go through all of them."""
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int")), lambda c: F.slice(items, c * size + 1, size)
    )
    return F.filter(pieces, lambda piece: F.size(piece) > 0)


def _placed(text: Column, pattern: str) -> Column:
    """Value and start (in characters) of every match, and what stands before it from the match before on.

    Starts are the lengths of the matches and of what lies between, added up; the work grows with the text.
    """
    pairs = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("b")
    )

    def with_before(found: Column) -> Column:
        return F.transform(
            found,
            lambda p, i: F.struct(p["m"].alias("m"), F.length(p["b"]).alias("skipped"), F.concat(F.coalesce(F.get(found, i - 1)["m"], F.lit("")), p["b"]).alias("before")),
        )

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + pair["skipped"]
        found = F.struct(pair["m"].alias("value"), begin.alias("start"), pair["before"].alias("before"))
        return F.struct((begin + F.length(pair["m"])).alias("at"), F.concat(acc["out"], F.array(found)).alias("out"))

    def chunk(acc: Column, piece: Column) -> Column:
        start = F.struct(acc["at"].alias("at"), F.array().cast(_PLACED).alias("out"))
        return _let(
            F.aggregate(piece, start, step), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out"))
        )

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_PLACED}>").alias("out"))
    matched = _let(F.filter(pairs, lambda p: p["m"].isNotNull()), with_before)
    return _let(matched, lambda found: F.aggregate(_chunks(found), begin, chunk, lambda acc: F.flatten(acc["out"])))


def _base_of(text: Column, k: int, kind: str) -> Column:
    spans = F.transform(
        F.filter(_placed(text, _PATTERNS[kind]), lambda m: _valid(kind, m["value"])),
        lambda m: F.struct(
            F.lit(k).alias("kind"), m["start"].alias("start"), (m["start"] + F.length(m["value"])).alias("end")
        ),
    )
    return F.when(text.rlike(_NEEDS[kind]), spans.cast(_SPANS)).otherwise(F.array().cast(_SPANS))


def base_spans(text: Column) -> Column:
    """Matches of the four fixed patterns that pass their test, by kind (its place in ``KINDS``) and start."""
    return F.concat(*[_base_of(text, k, kind) for k, kind in enumerate(KINDS)])


def described(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")


def _tokens(text: Column) -> Column:
    """Identifier-like tokens (with a digit or @), where they stand, and the word before (a digest of a very long one).

    The word before reaches back to the token before at most.
    """

    def token(m: Column) -> Column:
        value = F.regexp_replace(m["value"], r"[.:!?]+$", "")
        left = F.lower(F.regexp_extract(m["before"], r"(\S*+)\s*$", 1))
        return F.struct(
            value.alias("token"), m["start"].alias("start"), (m["start"] + F.length(value)).alias("end"),
            F.when(F.length(left) < _LONG_WORD, left).otherwise(F.md5(left)).alias("left"),
        )

    found = F.transform(_placed(text, _TOKEN), token).cast(_TOKENS)
    return F.when(text.rlike("[0-9@]"), found).otherwise(F.array().cast(_TOKENS))


def _with_kind(tokens: Column, base: Column) -> Column:
    """``tokens`` with the kind of the base span each one touches, or null.

    Tokens stand in order, so the spans near a piece of them are picked once for the piece, and again for its pieces.
    """

    def near(spans: Column, piece: Column) -> Column:
        begin, end = F.get(piece, 0)["start"], F.get(piece, F.size(piece) - 1)["end"]
        return F.filter(spans, lambda s: (s["start"] < end) & (s["end"] > begin))

    def named(t: Column, spans: Column) -> Column:
        touched = F.filter(spans, lambda s: (s["start"] < t["end"]) & (s["end"] > t["start"]))
        return F.struct(*[t[c].alias(c) for c in ("token", "start", "end", "left")], F.get(touched, 0)["kind"].alias("kind"))

    def small(piece: Column, spans: Column) -> Column:
        return _let(near(spans, piece), lambda few: F.transform(piece, lambda t: named(t, few)))

    def large(piece: Column, spans: Column) -> Column:
        return _let(near(spans, piece), lambda some: F.flatten(F.transform(_chunks(piece), lambda part: small(part, some))))

    pieces = _let(tokens, lambda all_: _chunks(all_, _CHUNK * _CHUNK))
    return _let(base, lambda spans: F.flatten(F.transform(pieces, lambda piece: large(piece, spans))))


def shape(token: Column) -> Column:
    """Every digit as 0 and every run of letters as a, so that identifiers built alike look alike."""
    return F.regexp_replace(F.regexp_replace(token, r"[0-9]", "0"), r"\p{L}+", "a")


def _patterns(token: Column, left: Column) -> Column:
    """Lexical patterns of a token: its shape, and its shape with the word before it."""
    s = shape(token)
    return F.array(F.struct(F.lit("").alias("left"), s.alias("shape")), F.struct(left.alias("left"), s.alias("shape")))


def learn_instances(uses: DataFrame, rounds: int, least_support: int, least_score: float) -> DataFrame:
    """``token, kind`` of the identifiers the bootstrap makes known beyond its seeds.

    ``uses`` has ``token``, ``left`` and ``kind`` (of the base span the token lies in, or null). Patterns and tokens are
    the two sides of a graph with one edge per distinct pair, weighted by nothing else. A pattern's score for a kind is
    the share of its tokens known as that kind; it counts from ``least_support`` known tokens and ``least_score`` on. A
    token's score is the noisy-or of its patterns, and it is known from ``least_score`` on in the next round.
    """
    edges = staged(
        uses.select("token", "kind", F.explode(_patterns(F.col("token"), F.col("left"))).alias("pattern"))
        .groupBy("pattern", "token").agg(F.max("kind").alias("kind"))
    )
    seeds = edges.groupBy("token").agg(F.max("kind").alias("kind"))
    known = seeds
    for _ in range(rounds):
        scored = (
            edges.select("pattern", "token").join(known.filter("kind is not null"), "token", "left")
            .groupBy("pattern").agg(
                F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("kind") == k).alias(f"k{k}") for k in range(len(KINDS))]
            )
        )
        best = F.sort_array(
            F.array(*[F.struct(F.col(f"k{k}").alias("hits"), F.lit(k).alias("kind")) for k in range(len(KINDS))]), asc=False
        )[0]
        scored = scored.select("pattern", best["kind"].alias("as_kind"), best["hits"].alias("hits"), (best["hits"] / F.col("n")).alias("score"))
        strong = scored.filter((F.col("hits") >= least_support) & (F.col("score") >= least_score))
        new = (
            edges.filter("kind is null").select("pattern", "token").join(strong, "pattern")
            .groupBy("token", "as_kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))).alias("score"))
            .filter(F.col("score") >= least_score)
            .groupBy("token").agg(F.max_by("as_kind", F.struct("score", -F.col("as_kind"))).alias("new_kind"))
        )
        known = staged(seeds.join(new, "token", "left").select("token", F.coalesce("kind", "new_kind").alias("kind")))
    return known.alias("k").join(seeds.alias("s"), "token").filter("s.kind is null and k.kind is not null").select("token", "k.kind")


def find_pii(
    df: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = 2, least_support: int = 5, least_score: float = 0.9
) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` and ``all_spans`` (structs), one row per row of ``df``.

    Base spans are the valid matches of four fixed patterns, in characters, end exclusive. They seed a bootstrap over
    identifier-like tokens, see ``learn_instances``; tokens it makes known that touch no base span are added. The digest
    covers the base spans only, ``spans`` lists all, by kind and start.

    Null texts count as empty and have no spans; repeated rows get equal spans; an empty table gives an empty result;
    other columns of ``df`` play no part. Everything learned is summed over the whole corpus before it is joined.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    seen = df.select(F.col(f"`{key}`").alias("doc_id"), whole.alias("text"))
    base = F.col("base")
    tokens = _let(
        F.struct(base_spans(F.col("text")).alias("base"), _tokens(F.col("text")).alias("tokens")),
        lambda both: F.struct(both["base"].alias("base"), _with_kind(both["tokens"], both["base"]).alias("tokens")),
    )
    found = staged(seen.select("doc_id", row_key("doc_id", "text").alias("row"), tokens.alias("both")).select("doc_id", "row", "both.base", "both.tokens"))
    uses = found.filter(F.size("tokens") > 0).select("row", F.explode("tokens").alias("t")).select(
        "row", "t.token", "t.left", "t.start", "t.end", "t.kind"
    )
    learned = learn_instances(uses.select("token", "left", "kind"), rounds, least_support, least_score)
    added = (
        uses.filter("kind is null").select("row", "token", "start", "end").join(learned, "token")
        .groupBy("row").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))
    )
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(_SPANS))))
    counts = [F.size(_of_kind(base, k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    joined = found.select("doc_id", "row", "base").join(added, "row", "left").withColumn("all_spans", spans)
    return joined.select(
        "doc_id", *counts, F.sha2(described(base), 256).alias("base_sha256"), described(F.col("all_spans")).alias("spans"),
        "all_spans", "row",
    )


def _of_kind(spans: Column, k: int) -> Column:
    return F.filter(spans, lambda s: s["kind"] == k)


def row_key(key: str, text: str) -> Column:
    """Names the content of a row: rows alike in key and text share it."""
    return F.xxhash64(F.col(key), F.col(text))


def _replaced(text: Column, spans: Column) -> Column:
    """``text`` with the spans (start, end, kind; in order of start) replaced, one piece of the text for some spans each."""
    name = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def piece_step(acc: Column, piece: Column) -> Column:
        stop = F.greatest(acc["at"], F.array_max(F.transform(piece, lambda s: s["end"])))
        part = F.substring(acc["rest"], F.lit(1), stop - acc["at"])

        def in_part(here: Column) -> Column:
            def step(inner: Column, s: Column) -> Column:
                fresh = F.array(F.substring(here, inner["at"] - acc["at"] + 1, s["start"] - inner["at"]), F.get(name, s["kind"]))
                return F.struct(
                    F.greatest(inner["at"], s["end"]).alias("at"),
                    F.when(s["start"] >= inner["at"], F.concat(inner["out"], fresh)).otherwise(inner["out"]).alias("out"),
                )

            start = F.struct(acc["at"].alias("at"), F.array().cast("array<string>").alias("out"))
            return F.aggregate(piece, start, step, lambda inner: F.array_join(inner["out"], ""))

        return F.struct(
            stop.alias("at"), F.substring(acc["rest"], stop - acc["at"] + 1, F.length(acc["rest"])).alias("rest"),
            F.concat(acc["out"], F.array(_let(part, in_part))).alias("out"),
        )

    begin = F.struct(F.lit(0).alias("at"), text.alias("rest"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(_chunks(spans), begin, piece_step, lambda acc: F.concat(F.array_join(acc["out"], ""), acc["rest"]))


def redact(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``df`` with each span of personal data replaced by its kind in brackets; spans that overlap become one.

    Only the rows that have spans are looked up by key; texts without spans, nulls among them, stay as they are. Columns
    of any name are kept.
    """
    row, spans = unused(df, "__row"), unused(df, "__spans")
    found = find_pii(df, key, text, **options).filter(F.size("all_spans") > 0)
    known = found.groupBy(F.col("row").alias(row)).agg(F.first("all_spans").alias(spans))
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))
    whole = F.col(f"`{text}`")
    clean = F.when(F.col(spans).isNull(), whole).otherwise(_let(by_start, lambda found: _replaced(whole, found)))
    keyed = df.withColumn(row, F.xxhash64(F.col(f"`{key}`"), F.coalesce(whole, F.lit(""))))
    columns = [clean.alias(c) if c == text else F.col(f"`{c}`") for c in df.columns]
    return keyed.join(known, row, "left").select(*columns)
