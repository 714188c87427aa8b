"""URL filters: allow and block rules by host and path, and a block list held in a cascade of Bloom filters.

The cascade answers membership of a list exactly for all hosts of a corpus, its
complete key universe, and is looked up without a join.  The first filter holds
the listed hosts; the second those of the other hosts that the first takes for
listed; the third the listed ones that the second takes for others; and so on
until none is mistaken.  A host's answer is that of the first filter that lacks
it.  A listed name covers its subdomains: which hosts of the corpus are listed is
found once, on the different hosts, when the cascade is built.

A filter is an array of 64-bit words, made by a group and a bit-wise or, and read
in a scalar subquery, so it reaches tasks with their code.  Its size follows the
number of listed hosts: about 1.44 bits for each halving of its error rate, and
8 more for the later levels.  If a cascade would pass ``most_bits``, hosts are
dealt by hash into parts with a cascade each, and the table is read once for each
part, so that no task holds more than one.

A rule is a host and the beginning of a path; it fits the host and its
subdomains.  Of the rules that fit the longest (host and path) decides, of equally
long ones that with the longer host, then block before allow.

Defined results: host is what follows the first ``://`` up to ``/``, ``?``, ``#``
or the end, A to Z lower-cased; path what follows up to ``?``, ``#`` or the end;
both are empty for a null url or one without ``://``, which no rule fits and no
list holds.  Hosts and paths may be of any length; names of a list are compared
in lower case, empty or null ones are left out.  Equal rows stay; an empty table
gives an empty result; other columns stay, those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: 16 MB a cascade.
MOST_BITS, MOST_RULES = 1 << 27, 1000
#: Error rate of the levels after the first: each leaves a sixteenth of what may be mistaken.
LATER = 1 / 16

Rule = tuple[str, str, str]  # verdict, host, path


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` and ``path``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    out = pages.withColumn("host", F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit("")))
    after = F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))
    return out.withColumn("path", after).withColumn("host", lowered(F.col("host")))


def rule_of(rules: Sequence[Rule]) -> Column:
    """The rule that decides ``host`` and ``path``: a struct of rule and verdict, null if none fits."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules are an expression too long; put hosts in the list")
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block", r[1:]))
    fits: Column | None = None
    for verdict, host, path in ordered:
        met = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        value = F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))
        fits = F.when(met, value) if fits is None else fits.when(met, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if fits is None else fits


def universe(hosts: DataFrame, listed: DataFrame) -> DataFrame:
    """(key, listed): the different hosts of ``hosts`` (host), and whether ``listed`` (name) has one or a domain above it.

    Of a host no more than the length of the longest listed name is looked at.
    """
    names = listed.select(lowered(F.trim("name")).alias("name")).where("name <> ''").distinct()
    keys = hosts.select(F.col("host").alias("key")).where("host <> ''").distinct()
    longest = names.agg(F.max(F.length("name"))).first()[0] or 0
    labels = F.split(F.expr(f"right(key, {longest + 1})"), "[.]")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = keys.select("key", F.explode(F.array_distinct(F.concat(F.array("key"), above))).alias("name"))
    # where the look began inside a label its rest is no domain: there must be a dot before
    met = met.where((F.col("name") == F.col("key")) | F.endswith("key", F.concat(F.lit("."), F.col("name"))))
    hit = met.join(names, "name", "left_semi").select("key").distinct()
    return keys.join(hit.withColumn("listed", F.lit(True)), "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed"))


class Level:
    """One filter: ``n_bits`` bits, ``hashes`` of which a key sets, in ``words`` (one row, one array)."""

    def __init__(self, keys: DataFrame, n: int, error: float, seed: int):
        self.hashes = max(1, round(log2(1 / error)))
        self.n_bits = 64 * ceil(max(1.0, n * log(1 / error) / log(2) ** 2) / 64)
        self.seed = seed
        self.words = cut(self._made(keys))

    def _places(self, key: str) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(self.seed * 64 + i), F.col(key)), F.lit(self.n_bits).cast("long")) for i in range(self.hashes)]

    def _made(self, keys: DataFrame) -> DataFrame:
        bits = keys.select(F.explode(F.array(*self._places("key"))).alias("bit"))
        one = F.expr("shiftleft(1L, cast(bit % 64 as int))")
        words = bits.groupBy(F.expr("bit div 64").alias("at")).agg(F.bit_or(one).alias("word"))
        every = keys.sparkSession.range(self.n_bits // 64).withColumnRenamed("id", "at").join(words, "at", "left")
        rows = F.sort_array(F.collect_list(F.struct("at", F.coalesce("word", F.lit(0).cast("long")).alias("word"))))
        return every.agg(F.transform(rows, lambda r: r["word"]).alias("words"))

    def has(self, key: str) -> Column:
        words, one = self.words.scalar(), F.lit(1).cast("long")
        word = lambda place: F.element_at(words, F.shiftright(place, 6).cast("int") + 1)
        tests = [F.call_function("shiftright", word(p), (p % 64).cast("int")).bitwiseAND(one) == one for p in self._places(key)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


class Cascade:
    """Filters whose answers are right for all keys of ``keys`` (key, listed), or for those of one part of several."""

    def __init__(self, keys: DataFrame, part: int = 0, parts: int = 1):
        self.part, self.parts = part, parts
        if parts > 1:
            keys = keys.where(part_of("key", parts) == part)
        n = {r["listed"]: r["n"] for r in keys.groupBy("listed").agg(F.count(F.lit(1)).alias("n")).collect()}
        inside, outside = keys.where("listed").select("key"), keys.where("not listed").select("key")
        self.levels: list[Level] = []
        first, others = n.get(True, 0), n.get(False, 0)
        error = first_error(first, others)
        # each level holds the one side and is asked for all that may be mistaken of the other
        while first:
            level = Level(inside, first, error, len(self.levels))
            self.levels.append(level)
            mistaken = cut(outside.where(level.has("key")))
            inside, outside, first, error = mistaken, inside, mistaken.count(), LATER

    def listed(self, key: str) -> Column:
        """Whether the key is listed; right for keys of the universe."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            out = F.when(~level.has(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def first_error(listed: int, others: int) -> float:
    """Error rate of the first level: about half as many others as listed hosts are mistaken."""
    return min(LATER, max(2.0**-30, listed / (2 * others))) if listed and others else LATER


def part_of(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("part"), F.col(key)), F.lit(parts))


def cascades(keys: DataFrame, most_bits: int = MOST_BITS) -> list[Cascade]:
    """One cascade, or one for each part of the keys if one would have more than ``most_bits`` bits."""
    n = keys.groupBy("listed").agg(F.count(F.lit(1)).alias("n")).collect()
    n = {r["listed"]: r["n"] for r in n}
    bits = n.get(True, 0) * (log(1 / first_error(n.get(True, 0), n.get(False, 0))) / log(2) ** 2 + 8)
    parts = max(1, ceil(bits / most_bits))
    return [Cascade(keys, i, parts) for i in range(parts)]


def judge(pages: DataFrame, rules: Sequence[Rule], listed: DataFrame, url: str = "url", most_bits: int = MOST_BITS) -> DataFrame:
    """Add host, path, rule (host and path of the rule that decides, else null) and verdict.

    Without a fitting rule the verdict is ``block`` for hosts that ``listed`` (name)
    or a name of it covers, else ``allow``.
    """
    split = with_parts(pages, url)
    keys = cut(universe(split.select("host"), listed))
    found = rule_of(rules)
    out: DataFrame | None = None
    made = cascades(keys, most_bits)
    for one in made:
        mine = split if len(made) == 1 else split.where(part_of("host", one.parts) == one.part)
        blocked = F.when((F.col("host") != "") & one.listed("host"), F.lit("block")).otherwise("allow")
        mine = mine.withColumn("rule", found["rule"]).withColumn("verdict", F.coalesce(found["verdict"], blocked))
        out = mine if out is None else out.unionByName(mine)
    return out
