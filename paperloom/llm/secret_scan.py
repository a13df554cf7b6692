"""Secrets in documents, told from examples by how many owners have them. DataFrame functions only.

Base patterns find credentials in their usual context. Every value so found, and every opaque token
(16 or more characters, letters and digits) is a candidate; the corpus-wide count of distinct owners
and repositories of each candidate's hash then decides. A value of one owner is live-looking, in however
many of its repositories it stands. One of more than `max_owners` owners is an example that was copied, and
so is one that few owners share but that has spread over more than `max_repositories`. A bare token that is the value of a live-looking credential
elsewhere is reported too, as kind `owned`: any run of the alphabet of assigned values, 8 or more long,
and any opaque token inside such a run. Full stops at a value's end don't make it another value. With
`any_value` false, bare tokens are opaque ones only and values are compared with their full stops.

Candidates are aggregated to one row for each (hash, owner, repository) before they are shuffled
further, and verdicts come back by a join that adaptive execution may split, so a value that a third
of all documents hold lands in no single task.

Defined results: null text is empty; each input row gives one output row, also when ids repeat or are
null; a null owner counts as one owner; very long texts are scanned whole (positions cost n**1.5 of
the matches of a text); empty input gives no rows. Extra columns are ignored by `scan`, kept by `redact`.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm import shared
from paperloom.llm.columns import free
from paperloom.llm.exact_dedup import FILTER_BITS, _bitmap, _hit

MAX_OWNERS, MAX_REPOSITORIES = 3, 6
ASKED_KEYS = 1_000_000


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = (
    "(?:" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + ")"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
# Maximal runs, so asking for the least length in the pattern drops the same matches.
ACCESS = "(AKIA[A-Z0-9]{12,})"
HEX = "([0-9a-f]{32,})"
OPAQUE = "([A-Za-z0-9+/_-]{16,})"
WIDE, WIDE_LEAST = "([A-Za-z0-9+/_.=-]{8,})", 8
#: kind, pattern (group 1 is the value), least length of the value, in the order of a span list.
KINDS = [("assign", ASSIGN, 8), ("access", ACCESS, 16), ("hex", HEX, 32)]
BASE = [kind for kind, _, _ in KINDS]


def _may_have(text: Column, kind: str) -> Column:
    """A cheap test that every text with a match of the kind passes; the patterns themselves cost far more."""
    if kind == "assign":
        low = F.lower(text)
        return reduce(or_, (low.contains(word) for word in ("passw", "secret", "token", "api")))
    if kind == "access":
        return text.contains("AKIA")
    if kind == "opaque":  # a digit and a letter in one run, looked for from its start only
        return text.rlike("(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16}")
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, though body uses it in inner functions."""
    return F.transform(F.array(value), body)[0]


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def _starts(steps: Column) -> Column:
    """Sums of the steps before each one, by blocks of about the square root of their number."""

    def whole(x):
        block = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x))).cast("int"))

        def of_blocks(y):
            count = F.ceil(F.size(x) / block).cast("int")
            sums = F.transform(F.sequence(F.lit(0), count - 1), lambda k: _total(F.slice(x, k * block + 1, block)))
            before = _let(sums, lambda s: F.transform(F.sequence(F.lit(0), count - 1), lambda k: _total(F.slice(s, F.lit(1), k))))
            return _let(before, lambda b: F.transform(
                F.sequence(F.lit(0), F.size(x) - 1),
                lambda i: b[F.floor(i / block).cast("int")]
                + _total(F.slice(x, (F.floor(i / block) * block + 1).cast("int"), i % block)),
            ))

        return of_blocks(x)

    return _let(steps, whole)


def _found(text: Column, kind: str, order: int, pattern: str, least: int, may: Column | None = None) -> Column:
    """Array of (start, end, order, kind, value): leftmost matches of the pattern, short values dropped.

    The text between matches gives the positions; Spark has no function that returns them.
    """
    empty = F.array().cast("array<struct<start:int,end:int,order:int,kind:string,value:string>>")
    regex = F.lit(pattern)
    matches, values = F.regexp_extract_all(text, regex, F.lit(0)), F.regexp_extract_all(text, regex, F.lit(1))
    parts = F.zip_with(
        F.split(text, pattern, -1), F.zip_with(matches, values, lambda m, v: F.struct(m.alias("m"), v.alias("v"))),
        lambda gap, x: F.struct(F.char_length(gap).alias("gap"), F.char_length(x["m"]).alias("length"), x["v"].alias("value")),
    )

    def placed(p):
        hits = F.slice(p, F.lit(1), F.size(p) - 1)  # after the last match there is only a gap
        return _let(hits, lambda h: F.zip_with(
            h, _starts(F.transform(h, lambda x: x["gap"] + x["length"])),
            lambda x, before: F.struct(
                (before + x["gap"]).alias("start"), (before + x["gap"] + x["length"]).alias("end"),
                F.lit(order).alias("order"), F.lit(kind).alias("kind"), x["value"].alias("value"),
            ),
        ))

    long_enough = F.filter(_let(parts, placed), lambda x: F.char_length(x["value"]) >= least)
    return F.when((_may_have(text, kind) if may is None else may) & text.rlike(pattern), long_enough).otherwise(empty)


def _hash(value: Column, any_value: bool) -> Column:
    """16 bytes that stand for a value."""
    return F.substring(F.unhex(F.sha2(F.regexp_replace(value, r"\.+$", "") if any_value else value, 256)), 1, 16)


def candidates(docs: DataFrame, id_col: str, text_col: str, owner: Column, repository: Column, any_value: bool = True) -> DataFrame:
    """One row for each candidate, and one with a null candidate for each document."""
    # The row number is only ever compared with itself further down this one lineage.
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
        owner.alias("owner"), repository.alias("repository"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    base = F.concat(*(_found(F.col("text"), kind, n, pattern, least) for n, (kind, pattern, least) in enumerate(KINDS)))
    opaque = F.filter(
        _found(F.col("text"), "owned", len(KINDS), OPAQUE, 16, _may_have(F.col("text"), "opaque")),
        lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]"),
    )
    if any_value:
        rows = _asked(rows, base)
        bare = _found(F.col("text"), "owned", len(KINDS) + 1, WIDE, WIDE_LEAST, F.col("asked"))
        wide = F.filter(bare, lambda x: F.char_length(F.rtrim(x["value"], F.lit("."))) >= WIDE_LEAST)
    found = rows.select("row", "id", "owner", "repository", base.alias("base"), opaque.alias("opaque"), *([wide.alias("wide")] if any_value else []))

    def apart(bare: str) -> Column:
        return F.filter(bare, lambda x: ~F.exists("base", lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))

    lists = ["base", apart("opaque")]
    if any_value:
        lists.append(F.filter(apart("wide"), lambda x: ~F.exists("opaque", lambda y: (x["start"] == y["start"]) & (x["end"] == y["end"]))))
    none = F.array(F.lit(None)).cast("array<struct<start:int,end:int,order:int,kind:string,value:string>>")
    one = F.explode(F.concat(none, *lists)).alias("one")
    every = found.select("row", "id", "owner", "repository", one).select(
        "row", "id", "owner", "repository", "one.start", "one.end", "one.order", "one.kind",
        _hash(F.col("one.value"), any_value).alias("hash"),
    )
    return every


def _asked(rows: DataFrame, base: Column) -> DataFrame:
    """rows with `asked`: whether the text has a wide token that may be a value which a base pattern finds somewhere.

    Almost all wide tokens are words, so only these texts are looked at further. Values are held in a bitmap
    of fixed size; a false hit costs a look. The texts asked for are few: their keys are broadcast up to
    ASKED_KEYS of them, else joined by shuffle.
    """
    bits = 4 * FILTER_BITS
    named = rows.select(F.explode(base).alias("one")).select(F.rtrim("one.value", F.lit(".")).alias("bare"))
    token = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WIDE), F.lit(1)))).alias("token")
    tokens = rows.select(F.xxhash64("text").alias("key"), token).select("key", F.rtrim("token", F.lit(".")).alias("bare"))
    hit = _hit(_bitmap(named, F.xxhash64("bare"), bits), F.xxhash64("bare"), bits)
    keys = shared.written(tokens.where(hit).select("key").distinct().withColumn("asked", F.lit(True)), "secret-texts")
    keys = F.broadcast(keys) if keys.count() <= ASKED_KEYS else keys
    met = rows.join(keys, F.xxhash64("text") == F.col("key"), "left")
    return met.withColumn("asked", F.coalesce("asked", F.lit(False))).drop("key")


def ownership(found: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """For each candidate hash: owners, repositories, whether a base pattern found it, live."""
    places = found.where("hash is not null").groupBy("hash", "owner", "repository").agg(F.max(F.col("kind").isin(BASE)).alias("named"))
    owners = places.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"), F.max("named").alias("named"))
    return owners.groupBy("hash").agg(
        F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"), F.max("named").alias("named")
    ).withColumn("live", F.col("named") & _is_owned(max_owners, max_repositories))


def _is_owned(max_owners: int, max_repositories: int) -> Column:
    return (F.col("owners") == 1) | ((F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None,
    repository: Column | None = None, max_owners: int = MAX_OWNERS, any_value: bool = True, max_repositories: int = MAX_REPOSITORIES,
) -> DataFrame:
    """Per row of docs: id, row, found = array of (start, end, order, kind, live, owners, repositories).

    found has all base matches and the bare tokens of kind `owned`, by start and then kind.
    """
    owner = F.col("source") if owner is None else owner
    repository = owner if repository is None else repository
    found = shared.written(candidates(docs, id_col, text_col, owner, repository, any_value), "secret-candidates")
    # Only values that a base pattern finds somewhere can be told or live: most bare tokens end here, by a bitmap.
    is_base, bits = F.col("kind").isin(BASE), 4 * FILTER_BITS
    named = _hit(_bitmap(found.where(is_base).select("hash"), F.xxhash64("hash"), bits), F.xxhash64("hash"), bits)
    some = found.where(F.col("hash").isNotNull() & (is_base | named))
    counted = ownership(some, max_owners, max_repositories).where("named").withColumnRenamed("hash", "counted_hash")
    # Another form of the key: adaptive execution may then split a value that very many documents have.
    judged = some.join(counted, F.col("hash") == F.concat("counted_hash", F.lit(b"")))
    kept = judged.where(is_base | F.col("live")).select("row", "id", F.struct("start", "end", "order", "kind", "live", "owners", "repositories").alias("one"))
    every = kept.unionByName(found.where("hash is null").select("row", "id"), allowMissingColumns=True)
    return every.groupBy("row", "id").agg(F.sort_array(F.collect_list("one")).alias("found")).select(F.col("id").alias(id_col), "row", "found")


def redact(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None,
    repository: Column | None = None, max_owners: int = MAX_OWNERS, mark: str = "[SECRET]", max_repositories: int = MAX_REPOSITORIES,
) -> DataFrame:
    """docs with live-looking spans replaced by the mark; widely copied examples stay as they are.

    A row whose id is null, or shared with another text, is matched by its text too. Only texts that may have
    such spans (a bitmap of fixed size says so) are shuffled to meet them.
    """
    key, both, cut_id, cut_key, live_name = free(docs, "_key", "_both", "_id", "_text_key", "_live")
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    pair = F.struct(F.col(id_col).alias("id"), F.col(key).alias("key"))
    spans = scan(docs.withColumn(key, text_hash).withColumn(both, pair), both, text_col, owner, repository, max_owners, max_repositories=max_repositories)
    live = F.filter("found", lambda x: x["live"])
    cuts = spans.where(F.size(live) > 0).groupBy(F.col(f"{both}.id").alias(cut_id), F.col(f"{both}.key").alias(cut_key))
    cuts = shared.written(cuts.agg(F.first(live).alias(live_name)), "secret-cuts")
    body = F.col(text_col)
    may = _hit(_bitmap(cuts, F.xxhash64(cut_id, cut_key), FILTER_BITS), F.xxhash64(F.col(id_col), text_hash), FILTER_BITS)
    joined = docs.where(may).join(cuts, docs[id_col].eqNullSafe(cuts[cut_id]) & (text_hash == cuts[cut_key]), "left")
    # Overlapping spans are merged: each piece of text between them is taken from the furthest end so far.
    step = F.aggregate(
        live_name, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.when(x["end"] <= acc["at"], acc).otherwise(F.struct(
            x["end"].alias("at"),
            F.concat(
                acc["out"],
                F.when(x["start"] >= acc["at"], F.concat(F.substring(body, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))).otherwise(F.lit("")),
            ).alias("out"),
        )),
    )
    masked = F.when(F.col(live_name).isNull(), body).otherwise(
        _let(step, lambda s: F.concat(s["out"], F.substring(body, s["at"] + 1, F.char_length(body))))
    )
    return docs.where(~may).unionByName(joined.withColumn(text_col, masked).select(docs.columns))
