"""Findings that share a file, symbol, package or fingerprint: entities, keys, groups.  No group is collected whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from codeloom.functions import scalars as S
from codeloom.plans.shared import saved, spread

#: Severities and kinds of keys by weight, how sure a kind is, longest text, entities and keys of a finding.
SEVERITIES = ("critical", "high", "medium", "low")
KINDS = ("fingerprint", "graph-node", "symbol", "rule-location", "file-range", "package", "file")
CONFIDENCE = {"fingerprint": "high", "graph-node": "high", "symbol": "high", "rule-location": "high", "file-range": "medium", "package": "low", "file": "low"}
TEXT, ENTITIES, KEYS = 240, 12, 12
ABSOLUTE = r"^(/|[A-Za-z]:/)"

#: Columns of findings: ``ref`` names one, the others may be null.
COLUMNS = "ref source rule_id file_path line col severity is_new dependents fingerprint step_index signal_index qualified_name body_hash scc_id packages package".split()


#: White space as Unicode has it.
SPACE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _text(c: str | Column) -> Column:
    """Trimmed and cut; null where nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    seen = lambda e: (e >= "!") & (e < "\x7f")  # by its first character
    trimmed = F.when(seen(c) & seen(F.substring(c, -1, 1)), c).otherwise(F.trim(c, F.lit(SPACE)))
    return F.when(F.length(trimmed) > 0, F.substring(trimmed, 1, TEXT))


def _tagged(kind: str, value: str | Column) -> Column:
    """An entity or a key as one text: the number of its kind, then its value."""
    return F.concat(F.lit(str(KINDS.index(kind))), value)


def _kind(tagged: str | Column) -> Column:
    return F.array(*map(F.lit, KINDS))[F.substring(tagged, 1, 1).cast("int")]


def _value(tagged: str | Column) -> Column:
    return F.substring(tagged, 2, 2**31 - 1)


#: What is kept of a finding to tell its entities, and its keys as well.
NAMED = ["file", "line", "col", "fingerprint", "symbol", "body", "scc", "packages"]
KEYED = [*NAMED, "rule_id", "alone"]


def _named(findings: DataFrame, *columns: str) -> DataFrame:
    """``columns``, those of ``KEYED`` with their texts cleaned; ``packages`` are tagged, and ``alone`` tells that the file is no key.

    A finding's entities of other kinds than package are six at most and never equal, so only packages are counted and
    compared.  A file has the least weight of all keys: it is the one that gives way where there are more than twelve.
    """
    rows = findings.select(
        *columns, "rule_id", "line", "col", F.replace(_text("file_path"), F.lit("\\"), F.lit("/")).alias("file"), _text("fingerprint").alias("fingerprint"), _text("qualified_name").alias("symbol"),
        F.concat(F.lit("body:"), _text("body_hash")).alias("body"), F.concat(F.lit("scc:"), _text("scc_id")).alias("scc"), F.col("packages").alias("given"), F.col("package").alias("one"),
    )
    absolute = lambda p: p.startswith("/") | ((F.substring(p, 2, 2) == ":/") & p.rlike(ABSOLUTE))
    own = F.when(~absolute(F.col("file")), _text(F.substring_index("file", "/", 1)))
    one = [F.col(c).isNotNull() for c in ("fingerprint", "file", "symbol", "body", "scc")] + [F.col("file").isNotNull() & F.col("line").isNotNull()]
    rows = rows.withColumn("own", own).withColumn("fixed", sum(c.cast("int") for c in one))
    none = F.array().cast("array<string>")
    listed = F.slice(F.filter(F.transform(F.coalesce("given", none), _text), lambda p: p.isNotNull()), 1, ENTITIES)
    found = F.array_distinct(F.filter(F.concat(listed, F.array(_text("one"), F.col("own"))), lambda p: ~absolute(p)))
    found = F.transform(F.slice(found, F.lit(1), ENTITIES - F.col("fixed")), lambda p: _tagged("package", p))
    only = F.when(F.col("own").isNotNull(), F.array(_tagged("package", F.col("own")))).otherwise(none)
    rows = rows.withColumn("packages", F.when(F.col("given").isNull() & F.col("one").isNull(), only).otherwise(found))
    return rows.select(*columns, *NAMED, "rule_id", (F.col("fixed") + F.size("packages") >= KEYS).alias("alone"))


def _range() -> Column:
    return F.concat("file", F.lit(":"), F.col("line").cast("string"), F.coalesce(F.concat(F.lit(":"), F.col("col").cast("string")), F.lit("")))


def _entities() -> Column:
    """The tagged entities of a row of ``_named``, with nulls for those it lacks."""
    own = [("fingerprint", "fingerprint"), ("file", "file"), ("file-range", _range()), ("symbol", "symbol"), ("graph-node", "body"), ("graph-node", "scc")]
    return F.concat(F.array(*[_tagged(kind, value) for kind, value in own]), "packages")


def _file_keys() -> list[Column]:
    """The tagged keys at a file, or nulls: a rule's place, a range and the file."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    located = F.when(F.col("file").isNotNull(), F.concat_ws("|", text("rule_id"), F.col("file"), text("line"), text("col")))
    return [_tagged("rule-location", located), _tagged("file-range", _range()), F.when(~F.col("alone"), _tagged("file", "file"))]


def _other_keys() -> list[Column]:
    return [_tagged("fingerprint", "fingerprint"), _tagged("graph-node", "body"), _tagged("graph-node", "scc"), _tagged("symbol", "symbol")]


def entities(findings: DataFrame) -> DataFrame:
    """ref, position (from 1), kind, id: what a finding names, at most twelve, none twice."""
    rows = _named(findings, "ref").select("ref", F.posexplode(F.array_compact(_entities())).alias("at", "e"))
    return rows.select("ref", (F.col("at") + 1).alias("position"), _kind("e").alias("kind"), _value("e").alias("id"))


def keys(findings: DataFrame) -> DataFrame:
    """ref, kind, value: the entities of a finding and its rule with its place, the twelve of most weight."""
    place, span, file = _file_keys()
    each = F.concat(F.array(*_other_keys(), place, span), F.sort_array("packages"), F.array(file))
    return _named(findings, "ref").select("ref", F.explode(each).alias("k")).filter("k is not null").select("ref", _kind("k").alias("kind"), _value("k").alias("value"))


def _weight(name: Column, names: tuple[str, ...]) -> Column:
    at = F.array_position(F.array(*map(F.lit, names)), name)
    return F.when(at > 0, at - 1).otherwise(len(names)).cast("int")


def _order() -> list[str | Column]:
    """Findings by severity, new ones first, most dependents first, then by source, place, rule and position.

    The first column is a number that grows with the next ones, so that most pairs of rows differ in it.
    """
    last = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(2**63 - 1))
    dependents, most = -F.coalesce(F.col("dependents").cast("long"), F.lit(0)), F.lit(2**58)
    head = _weight(F.col("severity"), SEVERITIES).cast("long") * 2 + (~F.coalesce("is_new", F.lit(False))).cast("long")
    return [head * 2**59 + F.greatest(F.least(dependents, most), -most), dependents, "source", "file_path", last("line"), last("col"), "rule_id", F.coalesce("fingerprint", F.lit("")), "step_index", "signal_index", "ref"]


def _group_id() -> Column:
    """A readable id: kind and value as a slug of 80 characters (one more where the cut would leave a dash)."""
    slug = S.slug(F.col("value"), 1000)
    cut = F.when(F.substring(slug, 80, 1) == "-", F.substring(slug, 1, 81)).otherwise(F.substring(slug, 1, 80))
    return F.concat(F.lit("corr-"), F.col("kind"), F.lit("-"), F.when(slug == "", "unknown").otherwise(cut))


#: A file, range or rule's place is counted beside its file's other findings, unless a file has more findings than this.
HOT = 1_000_000
#: Findings of a group that are first looked through for entities.
AHEAD = 12
_BUCKETS = 1 << 14


def _slot() -> Column:
    """A number that the keys of a file, of its ranges and of rules in it have in common: it follows from each of them alone."""
    last = F.substring_index("file", "|", -1)
    return F.when(F.col("file").isNotNull(), F.xxhash64(F.when(last.contains(":"), F.regexp_replace(last, r"(:-?[0-9]+)+$", "")).otherwise(last)))


def numbered(findings: DataFrame) -> DataFrame:
    """Findings in order with ``rank``, a number that grows with it; written once, so that groups compare numbers only.

    Columns: rank, ref, severity, is_new, dependents and those of ``KEYED``.
    """
    order = _order()
    made = {f"order_{k}": c for k, c in enumerate(order) if not isinstance(c, str)}
    names = [c if isinstance(c, str) else f"order_{k}" for k, c in enumerate(order)]
    ordered = findings.select(*COLUMNS, *[c.alias(name) for name, c in made.items()]).sort(*names).withColumn("rank", F.monotonically_increasing_id())
    return saved(_named(ordered.withColumn("is_new", F.coalesce("is_new", F.lit(False))), "rank", "ref", "severity", "is_new", "dependents"))


def _parts(rows: DataFrame, columns: list[str]) -> list[tuple[DataFrame, list[str]]]:
    """The keyed rows in two parts with no group in common, each with the columns that name a group.

    Keys at a file meet by a shuffle of one row a finding, and the groups of one file need no other.  A finding whose file
    has no other one with its column (or its line, without a column) is alone at its place: it has its file's key only.
    All other keys, and those at files with more than ``HOT`` findings (the list of these is short), are summed up before
    they are shuffled.
    """
    slots = rows.withColumn("slot", _slot())
    full = lambda part, by: [r[0] for r in part.groupBy(by.alias("b")).count().filter(F.col("count") > HOT).select("b").collect()]
    bucket, placed = F.pmod("slot", F.lit(_BUCKETS)), slots.filter("slot is not null")
    buckets = full(placed, bucket)
    hot = full(placed.filter(bucket.isin(*buckets)), F.col("slot")) if buckets else []
    away = F.coalesce(F.col("slot").isin(*hot), F.lit(False)) if hot else F.lit(False)
    near = slots.filter(F.col("slot").isNotNull() & ~away).select("slot", *dict.fromkeys(["rule_id", "file", "line", "col", "alone", *columns])).repartition("slot")
    near = near.withColumn("spot", F.xxhash64("slot", F.coalesce(F.col("col").cast("long"), F.col("line").cast("long"))))
    near = near.withColumn("met", F.count(F.lit(1)).over(W.Window.partitionBy("spot", "slot")) > 1)
    place, span, file = _file_keys()
    near = near.select("slot", F.explode(F.when(F.col("met"), F.array(file, place, span)).otherwise(F.array(file))).alias("key"), *columns)
    other = F.concat(F.array(*_other_keys()), "packages")
    other = F.when(away, F.concat(other, F.array(*_file_keys()))).otherwise(other) if hot else other
    far = slots.select(F.explode(other).alias("key"), *columns)
    return [(near.filter("key is not null"), ["slot", "key"]), (far.filter("key is not null"), ["key"])]


def groups(findings: DataFrame, member_limit: int | None = 10, group_limit: int | None = 20) -> DataFrame:
    """Groups of two or more findings with one key; of groups with the same members the first in order stays.

    Columns: id, kind, value, confidence, severity, is_new, dependents, n, primary, and members (the first
    ``member_limit`` refs in order).  Members are compared as they are shown; with ``member_limit=None`` they are not
    shown, and whole sets are compared by size and two digests that do not hang on the order of rows.  The first
    ``group_limit`` groups in order are given, or all with None.  A ref must name one finding.
    """
    rows = numbered(findings)
    parts = _parts(rows, ["rank", "ref", "severity", "is_new", "dependents"])
    totals = [F.count(F.lit(1)).alias("n"), F.max("is_new").alias("is_new"), F.max("dependents").alias("dependents")]
    if member_limit is None:
        # all in numbers, so that rows are summed up without a sort; a sum in two halves does not overflow
        other = F.xxhash64(F.lit(1), "ref")
        totals += [F.bit_xor(F.xxhash64("ref")).alias("x"), F.sum(F.shiftrightunsigned(other, 32)).alias("y"), F.sum(other.bitwiseAND(F.lit(2**32 - 1))).alias("z"), F.min("rank").alias("rank")]
        sums = reduce(DataFrame.unionByName, [part.groupBy(*by).agg(*totals).filter("n >= 2").select("key", "n", "is_new", "dependents", "x", "y", "z", "rank") for part, by in parts])
        sums = sums.join(spread(rows.select("rank", F.struct("ref", "severity").alias("top"))), "rank").drop("rank")
        signature, shown = F.struct("n", "x", "y", "z"), F.col("n")
    else:
        (near, at), (far, by) = parts
        most = max(member_limit, 1)
        place = lambda rows, by: rows.withColumn("place", F.row_number().over(W.Window.partitionBy(*by).orderBy("rank")))
        first = F.sort_array(F.collect_list(F.when(F.col("place") <= most, F.struct("place", "ref", "severity")))).alias("first")  # nulls are not collected
        sums = place(near, at).groupBy(*at).agg(first, *totals).filter("n >= 2").drop("slot")
        listed = place(far, by).filter(F.col("place") <= most).groupBy(*by).agg(first)
        sums = sums.unionByName(far.groupBy(*by).agg(*totals).filter("n >= 2").join(listed, by))
        sums = sums.withColumn("top", F.col("first")[0]).withColumn("members", F.slice("first.ref", 1, member_limit))
        signature, shown = F.array_sort("members"), F.size("members")
    again = F.row_number().over(W.Window.partitionBy("base").orderBy(_weight(F.col("kind"), KINDS), "value"))
    named = sums.withColumn("kind", _kind("key")).withColumn("value", _value("key")).withColumn("base", _group_id()).withColumn("again", again)
    named = named.withColumn("id", F.when(F.col("again") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("again").cast("string")))).withColumn("severity", F.col("top.severity"))
    rank = F.struct(_weight(F.col("severity"), SEVERITIES).alias("a"), (~F.col("is_new")).alias("b"), _weight(F.col("kind"), KINDS).alias("c"), (-shown).alias("d"), "id")
    sure = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])[F.col("kind")]
    columns = ["id", "kind", "value", sure.alias("confidence"), "severity", "is_new", "dependents", "n", F.col("top.ref").alias("primary"), *([] if member_limit is None else ["members"])]
    whole = named.select(signature.alias("signature"), rank.alias("rank"), F.struct(*columns).alias("g"))
    first = whole.groupBy("signature").agg(F.min_by("g", "rank").alias("g"), F.min("rank").alias("rank"))
    first = first if group_limit is None else first.orderBy("rank").limit(group_limit)
    return first.select("g.*")


def group_entities(findings: DataFrame, limit: int = ENTITIES) -> DataFrame:
    """kind, value (the key), place, entity_kind, entity_id: the first entities of each group's findings in order.

    The first ``AHEAD`` findings of a group mostly have them all.  Only groups that are larger and have shown fewer than
    ``limit`` by then are looked through as a whole.
    """
    parts = _parts(numbered(findings), ["rank", *NAMED])
    found = saved(reduce(DataFrame.unionByName, [_first_entities(part, by, limit) for part, by in parts]))
    short = found.filter((F.size("entities") < limit) & ~F.col("whole")).select("key")
    if not short.isEmpty():
        again = [_all_entities(part.join(short, "key", "left_semi"), by, limit) for part, by in parts]
        found = reduce(DataFrame.unionByName, [found.join(short, "key", "left_anti").drop("whole"), *again])
    each = found.select("key", F.posexplode("entities").alias("at", "e"))
    return each.select(_kind("key").alias("kind"), _value("key").alias("value"), (F.col("at") + 1).alias("place"), _kind("e").alias("entity_kind"), _value("e").alias("entity_id"))


def _first_entities(rows: DataFrame, by: list[str], limit: int) -> DataFrame:
    """key, entities of a group's first findings, and whether these are all; groups of one finding are none."""
    rows = rows.withColumn("n", F.row_number().over(W.Window.partitionBy(*by).orderBy("rank"))).filter(F.col("n") <= AHEAD + 1)
    first = F.sort_array(F.collect_list(F.when(F.col("n") <= AHEAD, F.struct("n", _entities().alias("e"))))).alias("first")  # nulls are not collected
    seen = rows.groupBy(*by).agg(first, F.max("n").alias("n")).filter("n >= 2").withColumn("whole", F.col("n") <= AHEAD)
    # no entity twice, and no nulls
    return seen.select("key", F.slice(F.array_except(F.flatten("first.e"), F.array(F.lit(None).cast("string"))), 1, limit).alias("entities"), "whole")


def _all_entities(rows: DataFrame, by: list[str], limit: int) -> DataFrame:
    """key and entities of all of a group's findings."""
    # rank and position in one number: a finding has fewer than 32 entities and gaps
    each = rows.select(*by, "rank", F.posexplode(_entities()).alias("position", "e")).filter("e is not null")
    seen = each.groupBy(*by, "e").agg(F.min(F.col("rank") * 32 + F.col("position")).alias("at"))
    placed = seen.withColumn("place", F.row_number().over(W.Window.partitionBy(*by).orderBy("at"))).filter(F.col("place") <= limit)
    return placed.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("place", "e"))).alias("first")).select("key", F.col("first.e").alias("entities"))
