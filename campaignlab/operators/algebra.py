"""Audience algebra on exact user bitmaps (E4d-f, E6, E10, E12 combined freely).

Users get consecutive numbers; a criterion ("bought Instant", "segment Loyal",
"must exclude") is a bitmap over them, kept as rows (criterion, word, bits) of 64
users each. Any and / or / not of criteria is then bitwise arithmetic on the
words of each place: sizes and members come without reading an order. Words, not
Spark's binary bitmaps, because those have no complement, which "not" needs.

An order is read once, when the bitmaps are built: distinct (criterion, user)
pairs are combined map-side, so a user with a third of all orders ships one row a
criterion and task. Words are at most 64th of the users per criterion, whatever
the orders.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from campaignlab.functions.blocks import USER, exclude_test_accounts
from campaignlab.functions.numbering import numbered
from campaignlab.sources.tables import CampaignTables

EVERYONE = "everyone"
EXCLUDED = "must exclude"
PRODUCT = "bought "
SEGMENT = "segment "


@dataclass(frozen=True)
class Audience:
    """An expression over criteria: ``has("bought Instant") & ~has("must exclude")``."""

    op: str
    parts: tuple

    def __and__(self, other: "Audience") -> "Audience":
        return Audience("and", (self, other))

    def __or__(self, other: "Audience") -> "Audience":
        return Audience("or", (self, other))

    def __invert__(self) -> "Audience":
        return Audience("not", (self,))

    def criteria(self) -> set[str]:
        return set(self.parts) if self.op == "has" else set().union(*(p.criteria() for p in self.parts))

    def bits(self, of) -> Column:
        """The expression over words; ``of(criterion)`` is the column of a criterion's bits."""
        if self.op == "has":
            return of(self.parts[0])
        if self.op == "not":
            return F.bitwise_not(self.parts[0].bits(of))
        a, b = (p.bits(of) for p in self.parts)
        return a.bitwiseAND(b) if self.op == "and" else a.bitwiseOR(b)


def has(criterion: str) -> Audience:
    return Audience("has", (criterion,))


def any_of(*criteria: str) -> Audience:
    out = has(criteria[0])
    for c in criteria[1:]:
        out = out | has(c)
    return out


def memberships(t: CampaignTables) -> DataFrame:
    """Distinct (criterion, User_ID): products bought (test account left out), segments, the
    must-exclude list. Null users belong to no audience."""
    bought = exclude_test_accounts(t.orders.select(USER, "Lottery")).filter(F.col("Lottery").isNotNull())
    rows = bought.select(F.concat(F.lit(PRODUCT), "Lottery").alias("criterion"), USER).unionByName(
        t.rfm.filter(F.col("Segment").isNotNull()).select(F.concat(F.lit(SEGMENT), "Segment").alias("criterion"), USER)).unionByName(
        t.abnormal.select(F.lit(EXCLUDED).alias("criterion"), USER))
    return rows.filter(F.col(USER).isNotNull()).distinct()


@dataclass(frozen=True)
class UserBitmaps:
    """``numbers`` (User_ID, n) and ``words`` (criterion, word, bits): bit ``n % 64`` of word ``n / 64``."""

    numbers: DataFrame
    words: DataFrame

    @classmethod
    def build(cls, members: DataFrame) -> "UserBitmaps":
        """From (criterion, User_ID) rows; repeated rows count once. ``everyone`` is added: all
        users that have a criterion, which is what "not" is taken from."""
        numbers = numbered(members.select(USER).distinct())
        placed = members.join(numbers, USER).select("criterion", "n").unionByName(
            numbers.select(F.lit(EVERYONE).alias("criterion"), "n"))
        words = placed.groupBy("criterion", F.floor(F.col("n") / 64).alias("word")).agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("n") % 64).cast("int"))).alias("bits"))
        return cls(numbers, words)

    def save(self, path: str) -> None:
        """Numbers, and words in one folder per criterion, so a question reads its own criteria only."""
        path = path.rstrip("/")
        self.numbers.write.mode("overwrite").parquet(f"{path}/numbers")
        self.words.hint("rebalance", "criterion").sortWithinPartitions("criterion", "word") \
            .write.mode("overwrite").partitionBy("criterion").parquet(f"{path}/words")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "UserBitmaps":
        path = path.rstrip("/")
        return cls(spark.read.parquet(f"{path}/numbers"),
                   spark.read.parquet(f"{path}/words").select(F.col("criterion").cast("string"), "word", "bits"))

    def _answered(self, asked: dict[str, Audience]) -> DataFrame:
        """Per word a column of bits for each expression, cut to the users there are."""
        names = sorted(set().union({EVERYONE}, *(a.criteria() for a in asked.values())))
        own = {c: f"_{k}" for k, c in enumerate(names)}
        words = self.words.filter(F.col("criterion").isin(names)).groupBy("word").agg(*[
            F.coalesce(F.bit_or(F.when(F.col("criterion") == c, F.col("bits"))), F.lit(0).cast("long")).alias(own[c]) for c in names])
        every = F.col(own[EVERYONE])
        return words.select("word", *[a.bits(lambda c: F.col(own[c])).bitwiseAND(every).alias(k) for k, a in asked.items()])

    def sizes(self, asked: dict[str, Audience]) -> DataFrame:
        """(audience, audience_size) of any number of expressions, from one pass over the words."""
        names = {f"a{k}": name for k, name in enumerate(asked)}
        words = self._answered(dict(zip(names, asked.values())))
        one = words.agg(*[F.coalesce(F.sum(F.bit_count(k)), F.lit(0)).alias(k) for k in names])
        return one.select(F.inline(F.array(*[F.struct(F.lit(name).alias("audience"), F.col(k).cast("long").alias("audience_size"))
                                             for k, name in names.items()])))

    def members(self, asked: Audience) -> DataFrame:
        """The users of an expression."""
        words = self._answered({"bits": asked}).filter(F.col("bits") != 0)
        n = self.numbers.withColumn("word", F.floor(F.col("n") / 64))
        return n.join(words, "word").filter(F.call_function("getbit", F.col("bits"), (F.col("n") % 64).cast("int")) == 1).select(USER)


def criteria(bitmaps: UserBitmaps) -> DataFrame:
    """(criterion, audience_size) of every bitmap."""
    return bitmaps.words.groupBy("criterion").agg(F.sum(F.bit_count("bits")).cast("long").alias("audience_size"))


def audience_modes(product: str, products: list[str], segment: str) -> dict[str, Audience]:
    """The extract page's modes as expressions: contactable users of each."""
    bought, others = has(PRODUCT + product), any_of(*[PRODUCT + p for p in products if p != product])
    contactable = ~has(EXCLUDED)
    anything = bought | others
    return {"Buy product": bought & contactable, "Not buy product": anything & ~bought & contactable,
            "Only buy product": bought & ~others & contactable, "All combinations": anything & contactable,
            "RFM Segments": has(SEGMENT + segment) & contactable, "Users must exclude": has(EXCLUDED)}
