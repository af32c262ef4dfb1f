"""Secret scans with corpus-wide ownership frequency. DataFrame operations only.

Patterns propose candidates in every whole text. Each candidate's value is
hashed, and the hashes are counted over the corpus by distinct repositories and
distinct owners: a value that many owners hold, or that is in many repositories,
is a widely copied example; one of a single owner and few repositories looks
live. Counting goes from (value, owner, repository) to (value, owner) to value,
each summed before it is shuffled, so a value that a third of all rows hold is a
few rows a task; rows learn the counts of such values by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import meet, stash

_VALUE = "[A-Za-z0-9+/_.=-]"
_KEY = r"""["']?\x20*[:=]\x20*["']?"""
#: Base kinds: pattern, group of the value, least characters of the value. A run of the last two is a match or
#: none whatever its length, so their least length stands in the pattern.
BASE = {
    "assign": (rf"(?i:password|passwd|secret|token|api_?key){_KEY}({_VALUE}+)", 1, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
#: Kinds that the method adds, where ownership makes them look live.
ADDED = {
    "provider": (r"gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 16),
    "pair": (rf"(?i:pwd|passphrase|credential|auth|private_?key|access_?key){_KEY}({_VALUE}{{12,}})", 1, 12),
}
KINDS = [*BASE, *ADDED]
#: A value looks live up to so many owners and repositories; it is an example from so many owners, or so many repositories, on.
LIVE_OWNERS, LIVE_REPOSITORIES = 1, 2
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 5


def spans(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """array<struct<start, kind, end, value>> of the leftmost non-overlapping matches, in code points.

    The text between two matches and the matches themselves alternate, so
    running lengths of both give the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(F.split(text, pattern, -1).alias("p"), found.alias("m"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        value = F.regexp_extract(x["m"], pattern, group) if group else x["m"]
        one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), value.alias("value")))
        kept = F.when(F.length(value) >= least, F.concat(acc["found"], one)).otherwise(acc["found"])
        return F.when(x["m"].isNull(), acc).otherwise(F.struct(end.alias("at"), kept.alias("found")))

    walked = F.aggregate(both, F.struct(F.lit(0).alias("at"), none.alias("found")), step)["found"]
    return F.when(text.rlike(pattern), walked).otherwise(none)


def candidates(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """(row, doc_id, owner, repository, found): the base and the added spans of each row, written once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    columns = [
        F.col("doc_id").cast("long"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repository)).alias("repository"),
    ]
    every = F.concat(*(spans(text, *x, kind) for kind, x in enumerate({**BASE, **ADDED}.values())))
    return stash(docs.select(F.monotonically_increasing_id().alias("row"), *columns, every.alias("found")), "secret-candidates")


def ownership(held: DataFrame) -> DataFrame:
    """(h1, h2, owners, repositories, n) of each hashed value, n the rows with it. held: (h1, h2, owner, repository), repeats allowed.

    A repository is one of its owner: those of two owners count as two whatever their names.
    """
    each = held.groupBy("h1", "h2", "owner", "repository").agg(F.count("*").alias("n"))
    owned = each.groupBy("h1", "h2", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    return owned.groupBy("h1", "h2").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("n"))


def live() -> Column:
    return (F.col("owners") <= LIVE_OWNERS) & (F.col("repositories") <= LIVE_REPOSITORIES)


def example() -> Column:
    return (F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repositories") >= EXAMPLE_REPOSITORIES)


def _joined(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    one = lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(found, one), ",")


def scan(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, most_owners, most_repositories) for each row of `docs`.

    spans has all base spans, and the added ones whose value is no `example`
    and overlaps no base span. n_live and n_example count the candidates with a
    `live` value and with an `example`; most_owners and most_repositories are
    those of the most copied value of the row, 0 without one. A null text counts as empty, a null owner or repository as one of
    their own; repeated rows count each but own once. Other columns are not
    looked at.
    """
    rows = candidates(docs, owner, repository)
    base = F.filter("found", lambda x: x["kind"] < len(BASE))
    plain = F.array_sort(F.transform(base, lambda x: F.struct(x["start"], x["kind"], x["end"])))
    of_kind = lambda k: F.filter("found", lambda x: x["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(BASE)]
    bases = rows.select("row", "doc_id", *counts, plain.alias("base"))
    held = rows.select("row", "owner", "repository", F.explode("found").alias("x")).select(
        "row", "owner", "repository", "x.start", "x.kind", "x.end", F.xxhash64("x.value").alias("h1"), F.xxhash64(F.lit("second"), "x.value").alias("h2")
    )
    told = meet(held, stash(ownership(held), "ownership"), ["h1", "h2"])
    added = (F.col("kind") >= len(BASE)) & ~example()
    by_row = told.groupBy("row").agg(
        F.collect_list(F.when(added, F.struct("start", "kind", "end"))).alias("added"),
        F.count(F.when(live(), 1)).alias("n_live"),
        F.count(F.when(example(), 1)).alias("n_example"),
        F.max("owners").alias("most_owners"),
        F.max("repositories").alias("most_repositories"),
    )
    apart = F.filter("added", lambda a: ~F.exists("base", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))
    every = F.array_sort(F.concat("base", F.coalesce(apart, F.expr("slice(base, 1, 0)"))))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return bases.join(by_row, "row", "left").select(
        "doc_id", *(f"n_{k}" for k in BASE), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(every).alias("spans"),
        *map(zero, ("n_live", "n_example", "most_owners", "most_repositories")),
    )
