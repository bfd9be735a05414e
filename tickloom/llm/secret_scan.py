"""Secrets in texts, told apart from copied examples by who owns the places they are found in.

Three kinds of base spans come from patterns alone. Further candidates are long tokens that mix digits, capitals and small
letters. Every candidate's value is hashed, and over the whole corpus the distinct repositories and owners of each hash
are counted. A value of at least ``COPIED_OWNERS`` owners or ``COPIED_REPOSITORIES`` repositories is a widely copied
example. Other tokens are taken for somebody's live credentials: they are added to the spans (kind ``owned``) if they touch
no base span. Base spans stay whatever they are, and every span says which of the two its value is.

All of it is column functions. Matches and the text between them come from the same pattern, and running lengths turn them
into positions (in code points, end exclusive), a thousand matches at a time, so a text with very many stays linear.
Counts are aggregated before each shuffle, first per (hash, owner, repository), so a value that fills the corpus is small
at once. Spans meet the counts by hash; hashes of more than a ten-thousandth of all candidates (at most 10,000, by that
rule) are broadcast instead, so no task gets all copies of one value.

Odd rows: a null or empty text has no spans. Null owners and repositories count as one value. Repeated rows are found each
on its own. Only the columns named are read; the result has a row per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import stored

# The patterns of the base kinds in the order in which they are listed, the group that holds the value, and
# the least length of that group. A shorter match counts for nothing but uses up its characters.
ASSIGN = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6,
)
# Within a run of the same characters a shorter match hides no longer one, so the length can be part of these two.
ACCESS = (r"AKIA[A-Z0-9]{16,}", 0, 20)
HEX = (r"[0-9a-f]{24,}", 0, 24)
BASE = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
KINDS = [*BASE, "owned"]

TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
TOKEN_CLASSES = ("[0-9]", "[A-Z]", "[a-z]")
COPIED_OWNERS = 3
COPIED_REPOSITORIES = 6
HEAVY_SHARE = 10_000
HEAVY_ROWS = 10_000
RUN = 1000


def _matches(text: Column, pattern: str, group: int) -> Column:
    """(gap, hit, value) of every match: characters before it since the last one, its own, and the group's text."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"), values.alias("value"))
    return F.when(text.rlike(pattern), zipped)


def _run(matches: Column) -> Column:
    """The spans of a few matches from the end of the match before, and how far they reach."""
    def step(state: Column, m: Column) -> Column:
        start = state["at"] + m["gap"]
        end = start + F.length(m["hit"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(
            start.alias("start"), end.alias("end"), m["value"].alias("value")))).alias("out"))

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.aggregate(matches, F.struct(F.lit(0).alias("at"), none.alias("out")), step)


def _placed(runs: Column) -> Column:
    """The spans of all runs, each moved by the runs before it."""
    def shift(state: Column, run: Column) -> Column:
        return F.struct((state["at"] + run["at"]).alias("at"), F.concat(state["starts"], F.array(state["at"])).alias("starts"))

    starts = F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), shift)["starts"]
    moved = F.zip_with(runs, starts, lambda run, at: F.transform(run["out"], lambda s: F.struct(
        (s["start"] + at).alias("start"), (s["end"] + at).alias("end"), s["value"].alias("value"))))
    return F.flatten(moved)


def spans(df: DataFrame, text: str, patterns: dict[str, tuple[str, int, int]]) -> DataFrame:
    """``df`` with an array of (start, end, value) per pattern, under the pattern's name, without those that are too short.

    Null where the pattern does not occur.
    """
    found = df.withColumns({k: _matches(F.col(text), p, g) for k, (p, g, _) in patterns.items()})
    runs = found.withColumns({k: F.when(F.col(k).isNotNull(), F.transform(_in_runs(k), _run)) for k in patterns})
    placed = runs.withColumns({k: F.when(F.col(k).isNotNull(), _placed(F.col(k))) for k in patterns})
    return placed.withColumns({k: _at_least(k, least) for k, (_, _, least) in patterns.items()})


def _in_runs(name: str) -> Column:
    """An array cut into arrays of ``RUN`` elements."""
    firsts = F.sequence(F.lit(0), F.floor((F.size(name) - 1) / RUN).cast("int"))
    return F.transform(firsts, lambda i: F.slice(F.col(name), i * RUN + 1, F.lit(RUN)))


def _at_least(name: str, least: int) -> Column:
    return F.filter(name, lambda s: F.length(s["value"]) >= least)


def candidates(docs: DataFrame, doc_id: str, text: str, owner: str | Column, repository: str | Column) -> DataFrame:
    """(row, doc_id, owner, repository, found) for every document; ``found`` has (start, kind, end, value) of all candidates.

    ``kind`` is the place in ``KINDS``, ``value`` the hash of the value. Stored, so that ``row`` stays what it is.
    """
    def column(c: str | Column) -> Column:
        return F.col(c) if isinstance(c, str) else c

    plain = docs.select(
        F.col(doc_id).alias("doc_id"), column(owner).cast("string").alias("owner"),
        column(repository).cast("string").alias("repository"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    seen = spans(plain, "text", {**BASE, "token": (TOKEN, 0, 20)}).drop("text")
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def listed(name: str, kind: int, kept=None) -> Column:
        column = F.filter(name, kept) if kept else F.col(name)
        return F.coalesce(F.transform(column, lambda s: F.struct(
            s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), F.md5(s["value"]).alias("value"))), none)

    base = seen.withColumn("base", F.concat(*[listed(k, i) for i, k in enumerate(BASE)]))

    def live(s: Column) -> Column:
        mixed = s["value"].rlike(TOKEN_CLASSES[0]) & s["value"].rlike(TOKEN_CLASSES[1]) & s["value"].rlike(TOKEN_CLASSES[2])
        return mixed & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    found = F.concat("base", listed("token", len(BASE), live))
    rows = base.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repository", found.alias("found"))
    return stored(rows, "secret-candidates")


def ownership(found: DataFrame) -> DataFrame:
    """(value, n, owners, repositories, copied) of every candidate value of the corpus."""
    one = found.select("owner", "repository", F.explode("found.value").alias("value"))
    places = one.groupBy("value", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    owners = places.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"))
    values = owners.groupBy("value").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))
    copied = (F.col("owners") >= COPIED_OWNERS) | (F.col("repositories") >= COPIED_REPOSITORIES)
    return values.withColumn("copied", copied)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str | Column = "source",
         repository: str | Column = "source") -> DataFrame:
    """(doc_id, spans) of every document; ``spans`` has (start, kind, end, copied) by start and kind.

    ``kind`` is the place in ``KINDS``; ``copied`` tells values found with many owners from those of few.
    """
    rows = candidates(docs, doc_id, text, owner, repository)
    values = stored(ownership(rows), "secret-ownership")
    total = values.agg(F.sum("n").alias("n")).first()["n"] or 0
    # Values above this number of candidates are fewer than HEAVY_SHARE, whatever the data.
    heavy = values.filter(F.col("n") > max(HEAVY_ROWS, total // HEAVY_SHARE)).select("value", "copied")
    light = values.filter(F.col("n") <= max(HEAVY_ROWS, total // HEAVY_SHARE)).select("value", "copied")
    one = rows.select("row", F.inline("found"))
    often = one.join(F.broadcast(heavy), "value")
    seldom = one.join(F.broadcast(heavy), "value", "left_anti").join(light, "value")
    judged = often.unionByName(seldom).filter((F.col("kind") < len(BASE)) | ~F.col("copied"))
    listed = F.sort_array(F.collect_list(F.struct("start", "kind", "end", "copied"))).alias("spans")
    per_row = judged.groupBy(F.col("row").alias("found_row")).agg(listed)
    joined = rows.join(per_row, rows["row"] == per_row["found_row"], "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int,copied:boolean>>")
    return joined.select("doc_id", F.coalesce("spans", none).alias("spans"))


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
