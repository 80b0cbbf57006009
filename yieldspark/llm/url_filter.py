"""URL rules by a Bloom filter cascade, in column expressions only (operator 10).

The first level holds the listed keys; the second those other keys of the
corpus that pass the first by mistake; the third the listed keys that pass the
second; and so on, until no key passes by mistake.  Over the complete universe
of the corpus's keys the cascade's answer is exact, and it is a constant of
the plan: looking a key up needs no join.  A list too long for one constant
is split by a hash of the key into as many cascades as it needs, each over its
share of the keys; a url goes to the cascade of its host's share, one pass a
share, so no size fails and no plan holds more than one share's constant.

Rules are keys too: a url's possible rules are its host's suffixes with as
many labels as some rule has, with its path's prefixes as long as some rule's.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: The rules (host, path) and their verdicts.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Hash functions of a level after the first (its false positive rate is two to the power of minus that); bits that the largest level of a cascade is planned to have at most.
HASHES, MOST_HASHES, MOST_BITS = 4, 16, 2**25
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Level:
    bits: int
    hashes: int
    words: list[int]
    salt: int

    def places(self, key: Column) -> Column:
        """The bits of a key."""
        m = F.lit(self.bits).cast("long")
        a, b = F.pmod(F.xxhash64(key, F.lit(self.salt)), m), F.pmod(F.xxhash64(key, F.lit(-1 - self.salt)), m)
        return F.transform(F.sequence(F.lit(0), F.lit(self.hashes - 1)), lambda i: F.pmod(a + b * i, m))

    def holds(self, key: Column) -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")  # folded to a constant
        bit = lambda p: F.getbit(F.element_at(words, (F.floor(p / 64) + 1).cast("int")), (p % 64).cast("int")) == 1
        return F.forall(self.places(key), bit)


def _level(keys: DataFrame, n: int, hashes: int, salt: int) -> Level:
    level = Level(64 * max(1, -(-int(n * hashes * 1.45) // 64)), hashes, [], salt)
    word = F.floor(F.col("p") / 64)
    rows = (
        keys.select(F.explode(level.places(F.col("key"))).alias("p"))
        .groupBy(word.alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b"))
        .collect()  # at most bits / 64 rows
    )
    level.words = [0] * (level.bits // 64)
    for r in rows:
        level.words[r["w"]] = r["b"]
    return level


@dataclass
class Cascade:
    """Exact membership of the keys of one universe."""

    levels: list[Level]

    def listed(self, key: Column) -> Column:
        """Whether the key is listed: the first level that lacks it decides, else the last."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            answer = F.when(~level.holds(key), F.lit(i % 2 == 1)).otherwise(answer)
        return F.coalesce(answer, F.lit(False))


def build_cascade(listed: DataFrame, universe: DataFrame, salt: int = 0) -> Cascade:
    """Cascade over the column ``key`` of both tables; listed keys outside the universe have no effect."""
    names = universe.select("key").where("key is not null").distinct()
    known = written(names.join(listed.select("key").distinct().withColumn("is_listed", F.lit(True)), "key", "left"), "filter-keys")
    sides = [known.where("is_listed").select("key"), known.where("is_listed is null").select("key")]
    sizes = [s.count() for s in sides]
    levels: list[Level] = []
    while sizes[len(levels) % 2]:
        i = len(levels)
        hashes = HASHES if i else min(MOST_HASHES, max(2, (sizes[1] // sizes[0]).bit_length() + 1))
        levels.append(_level(sides[i % 2], sizes[i % 2], hashes, 1000 * salt + i))
        # the other side's keys that pass by mistake come next
        sides[1 - i % 2] = written(sides[1 - i % 2].where(levels[-1].holds(F.col("key"))), "filter-keys")
        sizes[1 - i % 2] = sides[1 - i % 2].count()
    return Cascade(levels)


def share(key: Column, shares: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-7)), F.lit(shares))


def build_cascades(listed: DataFrame, universe: DataFrame, salt: int = 0, most_bits: int = MOST_BITS) -> list[Cascade]:
    """A cascade for each share of the keys, of a number that keeps every level near ``most_bits`` or below."""
    n = listed.select("key").where("key is not null").distinct().count()
    shares = max(1, -(-int(n * MOST_HASHES * 1.45) // most_bits))
    if shares == 1:
        return [build_cascade(listed, universe, salt)]
    return [build_cascade(listed.where(share(F.col("key"), shares) == i), universe.where(share(F.col("key"), shares) == i), salt) for i in range(shares)]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url; both empty without ``://``."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(url)), "^[^?#]*", 0)
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    return F.when(has, F.translate(raw, _UPPER, _LOWER)).otherwise(""), F.when(has, path).otherwise("")


def rule_keys(host: Column, path: Column, rules=RULES) -> Column:
    """Keys under which a rule for this url could stand."""
    labels, lengths = sorted({h.count(".") + 1 for h, _, _ in rules}), sorted({len(p) for _, p, _ in rules})
    keys = [
        F.when(F.length(path) >= n, F.concat(F.substring_index(host, ".", -k), F.substring(path, F.lit(1), F.lit(n)))) for k in labels for n in lengths
    ]
    return F.array_distinct(F.array_compact(F.array(*keys)))


def judge(pages: DataFrame, listed_hosts: DataFrame | None = None, rules=RULES, most_bits: int = MOST_BITS) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` per row.

    The longest rule that fits decides.  Urls without a rule are blocked if
    their whole host is in ``listed_hosts`` (column ``key``), else allowed.  A
    null url, or one without ``://``, has no host, no path and no rule and is
    allowed.  Null and repeated ids are judged row by row; other columns are
    ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    keys = rows.select(F.explode(rule_keys(F.col("host"), F.col("path"), rules)).alias("key"))
    named = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(h + p).alias("key"), F.lit(v).alias("v")) for h, p, v in rules])).alias("r")).select("r.*")
    any_rule = build_cascade(named, keys, 1)
    blocked = build_cascade(named.where("v = 'block'"), keys, 2)
    hosts = rows.select(F.col("host").alias("key"))
    listed = build_cascades(listed_hosts if listed_hosts is not None else hosts.limit(0), hosts, 3, most_bits)
    fit = F.filter(rule_keys(F.col("host"), F.col("path"), rules), any_rule.listed)
    longest = F.array_max(F.transform(fit, lambda k: F.struct(F.length(k).alias("n"), k.alias("rule"))))["rule"]
    judged = rows.withColumn("rule", longest)

    def with_verdict(rows: DataFrame, cascade: Cascade) -> DataFrame:
        block = F.when(F.col("rule").isNotNull(), blocked.listed(F.col("rule"))).otherwise(cascade.listed(F.col("host")))
        return rows.withColumn("verdict", F.when(block, "block").otherwise("allow"))

    if len(listed) == 1:
        return with_verdict(judged, listed[0])
    mine = share(F.col("host"), len(listed))
    return reduce(DataFrame.unionByName, [written(with_verdict(judged.where(mine == i), c), "judged-urls") for i, c in enumerate(listed)])


def mobile_hosts(pages: DataFrame) -> DataFrame:
    """The corpus's hosts of mobile mirrors: their first label is ``m``."""
    host, _ = host_and_path(F.col("url").cast("string"))
    return pages.select(host.alias("key")).where("key like 'm.%'").distinct()
