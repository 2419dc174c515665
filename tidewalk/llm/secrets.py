"""Secret scans with corpus-wide ownership frequencies, on DataFrame functions only.

Base kinds (leftmost, non-overlapping, positions in code points):

* ``assign``: a credential word, ``:`` or ``=``, and a value of 8 or more characters;
* ``access``: an access key id of 16 or more characters;
* ``hex``: 32 or more lower-case hexadecimal digits.

Runs of 24 or more token characters are further candidates.  The digest of each candidate value is
counted over the corpus by distinct repositories and owners.  A value that many owners
share is an ``example``; one that is seen with few owners and looks random is ``live``;
others are ``weak``.  Live runs that overlap no base span are added as kind ``owned``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import cut, spread_join

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a shorter run holds no longer one, so this equals matching runs and dropping the short
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}"
KINDS = ("assign", "access", "hex", "owned")
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your_|xxxx|1234567"


def _matches(docs: DataFrame) -> DataFrame:
    """Add, for each kind, its matches and the lengths of the text before each."""
    text = F.coalesce("text", F.lit(""))
    hits = docs.select("*", *(F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"hit{i}") for i, p in enumerate((ASSIGN, ACCESS, HEX, RUN))))
    gaps = [F.when(F.size(f"hit{i}") > 0, F.transform(F.split(text, p, -1), F.length)).alias(f"gap{i}") for i, p in enumerate((ASSIGN, ACCESS, HEX, RUN))]
    return hits.select("*", *gaps)


def _looks_live(value: Column) -> Column:
    """Digits and letters, ten or more different characters, and no placeholder word."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 10) & ~value.rlike(PLACEHOLDER)


def candidates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", repo: str = "source", owner: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(rows, candidates)``: a row (uid, doc_id, digest) per document, and one per candidate span.

    ``owner`` defaults to the repository column.  Candidates: uid, kind (its number), start, end, value digest, looks, repo, owner.
    """
    docs = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
        F.coalesce(F.col(repo).cast("string"), F.lit("")).alias("repo"), F.coalesce(F.col(owner or repo).cast("string"), F.lit("")).alias("owner"),
    )
    found = cut(_matches(docs).withColumn("digest", F.xxhash64("text")).drop("text"), "matches")
    def numbered(i):
        return F.transform(f"hit{i}", lambda h, n: F.struct(F.lit(i).alias("kind"), n.alias("n"), F.col(f"gap{i}")[n].alias("gap"), h.alias("hit")))

    each = [numbered(i) for i in range(len(KINDS))]
    spans = found.where(" or ".join(f"size(hit{i}) > 0" for i in range(4))).select("uid", "repo", "owner", F.explode(F.concat(*each)).alias("m")).select("uid", "repo", "owner", "m.*")
    so_far = W.partitionBy("uid", "kind").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    length = F.length("hit")
    spans = spans.withColumn("end", F.sum(F.col("gap") + length).over(so_far)).withColumn("start", F.col("end") - length)
    spans = spans.withColumn("value", F.when(F.col("kind") == 0, F.regexp_extract("hit", ASSIGN, 2)).otherwise(F.col("hit")))
    spans = spans.withColumn("looks", _looks_live(F.col("value")))
    spans = spans.where("kind in (1, 2) or kind = 0 and length(value) >= 8 or kind = 3 and looks")
    return found.select("uid", "doc_id", "digest"), cut(spans.select("uid", "kind", "start", "end", F.sha2("value", 256).alias("value"), "looks", "repo", "owner"), "candidates")


def ownership(spans: DataFrame) -> DataFrame:
    """``(value, n, n_repos, n_owners)``: how often each value is there, and over how many repositories and owners it is spread.

    Every count is summed up before it is shuffled, so a value that is everywhere is a few rows a task.
    """
    per = spans.groupBy("value", "repo", "owner").agg(F.count(F.lit(1)).alias("n"))
    repos = per.groupBy("value", "repo").agg(F.sum("n").alias("n")).groupBy("value").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_repos"))
    owners = per.select("value", "owner").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("n_owners"))
    return repos.join(owners, "value")


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", repo: str = "source", owner: str | None = None, max_owners: int = 2) -> DataFrame:
    """One row per input row: ``doc_id, digest, spans``.  ``repo`` and ``owner`` name columns; where documents know one of them only, it stands for both.

    ``digest`` is xxhash64 of the text; ``spans`` an array of (start, kind, end, verdict, n_repos,
    n_owners), by start and then kind as listed in KINDS; verdict is ``live``, ``example`` or ``weak``.  Null and empty
    texts have no spans, long ones are read whole; null ids, repositories and owners are kept (a null repository or owner is one like any other); repeated rows repeat; other columns, whatever
    their names, are ignored; an empty table gives an empty result.
    """
    rows, spans = candidates(docs, text, doc_id, repo, owner)
    known = spread_join(spans, cut(ownership(spans), "ownership"), "value")
    verdict = F.when((F.col("n_owners") > max_owners) | (F.col("n_repos") > max_owners), "example").when(F.col("looks"), "live").otherwise("weak")
    known = known.withColumn("verdict", verdict).where("kind < 3 or verdict = 'live'")
    # a run goes if a base span overlaps it
    by = W.partitionBy("uid").orderBy("start", "kind", "end")
    known = known.withColumn("before", F.max(F.expr("if(kind < 3, end, null)")).over(by.rowsBetween(W.unboundedPreceding, W.currentRow)))
    known = known.withColumn("after", F.min(F.expr("if(kind < 3, start, null)")).over(by.rowsBetween(W.currentRow, W.unboundedFollowing)))
    known = known.where("kind < 3 or coalesce(before, 0) <= start and coalesce(after, end) >= end")
    per = known.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "verdict", "n_repos", "n_owners"))).alias("spans"))
    none = F.array().cast(per.schema["spans"].dataType)
    return rows.join(per, "uid", "left").select("doc_id", "digest", F.coalesce("spans", none).alias("spans"))


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of ``scan``'s rows."""
    names = F.array(*map(F.lit, KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s.kind], s.start, s.end)), ",")
    base = F.filter("spans", lambda s: s.kind < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s.verdict == "live")).cast("long").alias("n_live"), F.size(F.filter("spans", lambda s: s.verdict == "example")).cast("long").alias("n_example"),
    )


def redact(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", marker: str = "[SECRET]", n_chars: str | None = "n_chars", **how) -> DataFrame:
    """``docs`` with every live or weak span replaced by ``marker``; widely copied examples stay as they are.

    Every row and column stays, whatever the columns' names, and ``n_chars``, where given and there, follows the new text.  Overlapping spans are one marker.
    Null texts stay null; null ids and repeated rows are treated like others; an empty table gives an empty result.
    """
    found = scan(docs, text, doc_id, **how).where("size(spans) > 0")
    found = found.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.filter("spans", lambda s: s.verdict != "example").alias("_spans")).where("size(_spans) > 0").dropDuplicates(["_id", "_digest"])
    # the documents' own columns stay in a struct, out of the way of the names used here
    held = docs.select(F.struct(*docs.columns).alias("_row"), F.col(doc_id).alias("_doc"), F.xxhash64(text).alias("_sum"))
    # documents with secrets grow with the corpus: joined by shuffle at every size
    held = held.join(found.hint("merge"), F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_sum") == F.col("_digest")), "left")
    old = F.col("_row")[text]
    # state: the text so far, and where in the old text to go on
    step = lambda at, s: F.when(s.end <= at.pos, at).otherwise(
        F.struct(F.concat(at.out, F.when(s.start >= at.pos, F.concat(old.substr(at.pos + 1, s.start - at.pos), F.lit(marker))).otherwise(F.lit(""))).alias("out"), s.end.alias("pos"))
    )
    tail = lambda at: F.concat(at.out, old.substr(at.pos + 1, F.length(old).cast("long") - at.pos))
    new = F.when(F.col("_spans").isNull(), old).otherwise(F.aggregate("_spans", F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("pos")), step, tail))
    held = held.select("_row", "_spans", new.alias("_new"))
    own = {c: F.col("_row")[c] for c in docs.columns}
    own[text] = F.col("_new")
    if n_chars and n_chars in own:
        own[n_chars] = F.when(F.col("_spans").isNull(), own[n_chars]).otherwise(F.length("_new").cast(docs.schema[n_chars].dataType))
    return held.select(*(x.alias(c) for c, x in own.items()))
