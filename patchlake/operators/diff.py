"""Unified diffs to files, hunks and lines.

A raw diff is cut into files inside its row, before any line is exploded, so every
window below is partitioned by file: one huge change set is many small partitions,
and text before the first file header is never exploded at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import filled, first_filled, in_order, wide_trim

FILE = ["pr", "file_ord"]
_HUNK = r"\A@@\s+-(\d+)(?:,(\d+))?\s+\+(\d+)(?:,(\d+))?\s+@@(.*)\z"


def file_texts(diffs: DataFrame) -> DataFrame:
    """Rows (pr, file_ord, text) from (pr, raw_diff), files numbered from 1."""
    chunks = F.filter(F.split("raw_diff", r"(?<=\n)(?=diff --git )|\A(?=diff --git )", -1), lambda x: x.startswith("diff --git "))
    d = diffs.select("pr", F.posexplode(chunks).alias("pos", "text"), F.size(chunks).alias("n"))
    # the line feed before the next file's header ends a line; the one at the end of the diff begins an empty one
    text = F.when(F.col("pos") + 1 < F.col("n"), F.regexp_replace("text", r"\r?\n\z", "")).otherwise(F.col("text"))
    return d.select("pr", (F.col("pos") + 1).alias("file_ord"), text.alias("text"))


def file_lines(diffs: DataFrame) -> DataFrame:
    """Rows (pr, file_ord, n, line) from (pr, raw_diff); line 0 of a file is its header."""
    return file_texts(diffs).select("pr", "file_ord", F.posexplode(F.split("text", r"\r?\n", -1)).alias("n", "line"))


def _header_paths(line: Column) -> tuple[Column, Column]:
    quoted = r"\Adiff --git \"a/(.+)\" \"b/(.+)\"\z"
    rest = wide_trim(F.substring(line, 12, 1 << 30))
    at = F.instr(rest, " b/")
    old = F.regexp_replace(F.substring(rest, F.lit(1), at - 1), r"\Aa/", "")
    new = F.substring(rest, at + 3, F.length(rest))
    is_quoted = line.rlike(quoted)
    pick = lambda group, part: F.when(is_quoted, F.regexp_extract(line, quoted, group)).when(at > 0, part).otherwise(rest)
    return pick(1, old), pick(2, new)


_DIRECTIVE = r"\A(new file mode|deleted file mode|similarity index|rename from|rename to|copy from|copy to|Binary files)"


def _role(line: Column, first: Column, inside: Column) -> Column:
    """What a line of a file is; ``first`` is the file's header line, ``inside`` holds from the first hunk header on."""
    return (
        F.when(first, "header")
        .when(~inside & line.rlike(_DIRECTIVE), "directive")
        .when(line.startswith("--- "), "old")
        .when(line.startswith("+++ "), "new")
        .when(line.startswith("@@ "), F.when(line.rlike(_HUNK), "hunk").otherwise("skip"))
        .when(~inside, "skip")
        .when(line.startswith("+") & ~line.startswith("+++"), "add")
        .when(line.startswith("-") & ~line.startswith("---"), "delete")
        .when(line.startswith(" ") | (line == ""), "context")
        .otherwise("skip")
    )


def parsed_files(diffs: DataFrame) -> DataFrame:
    """Rows (pr, file_ord, lines, old_path, new_path, status, is_binary, additions, deletions, header_lines) of (pr, raw_diff).

    ``lines`` is array<struct<role, line>>. The same as ``diff_files`` of
    ``marked_lines``, but read with array functions inside the row of the file: no line
    is exploded and nothing is shuffled. Columns of ``diffs`` besides these are dropped.
    """
    d = file_texts(diffs).select(*FILE, F.split("text", r"\r?\n", -1).alias("raw"))
    at = F.array_position(F.transform("raw", lambda line, i: (i > 0) & line.rlike(_HUNK)), F.lit(True))
    d = d.withColumn("hunk_at", F.when(at > 0, at - 1).otherwise(F.size("raw")))
    d = d.select(*FILE, F.transform("raw", lambda line, i: F.struct(_role(line, i == 0, i >= F.col("hunk_at")).alias("role"), line.alias("line"))).alias("lines"))
    shown = lambda line: wide_trim(F.substring(line, 5, 1 << 30))
    is_null = lambda x: shown(x["line"]) == "/dev/null"
    last = lambda array: F.try_element_at(array, F.lit(-1))
    of = lambda array, role: F.filter(array, lambda x: x["role"] == role)
    git_old, git_new = _header_paths(F.col("lines")[0]["line"])
    old_path = lambda old, header: F.when(old.isNull(), header).when(~is_null(old), F.regexp_replace(shown(old["line"]), r"\Aa/", ""))
    old, new = last(of(F.col("lines"), "old")), last(of(F.col("lines"), "new"))
    # the old path as it stands where the last new one is read
    after_new = F.array_position(F.transform(F.reverse("lines"), lambda x: x["role"] == "new"), F.lit(True)).cast("int") - 1
    old_then = last(of(F.slice("lines", 1, F.greatest(F.lit(0), F.size("lines") - after_new)), "old"))
    new_path = F.when(new.isNull(), git_new).when(is_null(new), F.coalesce(old_path(old_then, git_old), F.lit(""))).otherwise(F.regexp_replace(shown(new["line"]), r"\Ab/", ""))
    line_status = lambda x: (
        F.when((x["role"] == "old") & is_null(x), "added")
        .when((x["role"] == "new") & is_null(x), "deleted")
        .when(x["role"] == "directive", F.when(x["line"].startswith("new file"), "added").when(x["line"].startswith("deleted file"), "deleted").when(x["line"].startswith("rename"), "renamed").when(x["line"].startswith("copy"), "copied").when(x["line"].startswith("Binary"), "binary"))
    )
    heads = F.filter("lines", lambda x: x["role"].isin("header", "directive", "old", "new"))
    return d.select(
        *FILE, "lines", old_path(old, git_old).alias("old_path"), new_path.alias("new_path"), F.coalesce(last(F.array_compact(F.transform(heads, line_status))), F.lit("modified")).alias("status"),
        F.exists("lines", lambda x: (x["role"] == "directive") & x["line"].startswith("Binary files")).alias("is_binary"),
        F.size(of(F.col("lines"), "add")).cast("long").alias("additions"), F.size(of(F.col("lines"), "delete")).cast("long").alias("deletions"),
        F.transform(heads, lambda x: x["line"]).alias("header_lines"),
    )


def marked_lines(diffs: DataFrame) -> DataFrame:
    """``file_lines`` with what each line is: ``role`` is header, old, new, hunk, directive, add, delete, context or skip.

    As the format's reader tests header lines first, a removed or added line whose
    text begins with ``-- `` or ``++ `` counts as a path line. Malformed hunk headers
    are skipped and leave the hunk before them open.
    """
    d = file_lines(diffs)
    w = Window.partitionBy(*FILE).orderBy("n")
    line = F.col("line")
    d = d.withColumn("hunk_ord", F.sum(((F.col("n") > 0) & line.rlike(_HUNK)).cast("int")).over(w))
    return d.withColumn("role", _role(line, F.col("n") == 0, F.col("hunk_ord") > 0))


def diff_files(marked: DataFrame) -> DataFrame:
    """Rows (pr, file_ord, old_path, new_path, status, is_binary, additions, deletions, header_lines) of ``marked_lines``."""
    line, role = F.col("line"), F.col("role")
    shown = wide_trim(F.substring(line, 5, 1 << 30))
    null = shown == "/dev/null"
    git_old, git_new = _header_paths(line)
    # a struct keeps a null path apart from no path line
    old_event = F.when(role == "header", F.struct(git_old.alias("p"))).when(role == "old", F.struct(F.when(~null, F.regexp_replace(shown, r"\Aa/", "")).alias("p")))
    w = Window.partitionBy(*FILE).orderBy("n")
    status = (
        F.when((role == "old") & null, "added")
        .when((role == "new") & null, "deleted")
        .when(role == "directive", F.when(line.startswith("new file"), "added").when(line.startswith("deleted file"), "deleted").when(line.startswith("rename"), "renamed").when(line.startswith("copy"), "copied").when(line.startswith("Binary"), "binary"))
    )
    d = marked.withColumn("old_event", old_event).withColumn("old_now", F.last("old_event", ignorenulls=True).over(w))
    new_event = F.when(role == "header", git_new).when(role == "new", F.when(null, F.coalesce(F.col("old_now.p"), F.lit(""))).otherwise(F.regexp_replace(shown, r"\Ab/", "")))
    d = d.withColumn("new_event", new_event).withColumn("status_event", status)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("n")))
    heads = F.when(role.isin("header", "directive", "old", "new"), line)
    return (
        d.groupBy(*FILE)
        .agg(
            last("old_event")["p"].alias("old_path"), last("new_event").alias("new_path"), F.coalesce(last("status_event"), F.lit("modified")).alias("status"),
            F.bool_or((role == "directive") & line.startswith("Binary files")).alias("is_binary"),
            F.count_if(role == "add").alias("additions"), F.count_if(role == "delete").alias("deletions"),
            F.filter(in_order(heads, F.col("n")), lambda x: x.isNotNull()).alias("header_lines"),
        )
    )


def diff_hunks(marked: DataFrame) -> DataFrame:
    """Rows (pr, file_ord, hunk_ord, header, old_start, old_lines, new_start, new_lines); a missing count is 1."""
    part = lambda k: F.regexp_extract("line", _HUNK, k)
    count = lambda k: F.coalesce(filled(part(k)).cast("long"), F.lit(1))
    return marked.where("role = 'hunk'").select(*FILE, "hunk_ord", F.col("line").alias("header"), part(1).cast("long").alias("old_start"), count(2).alias("old_lines"), part(3).cast("long").alias("new_start"), count(4).alias("new_lines"))


def diff_lines(marked: DataFrame) -> DataFrame:
    """Rows (pr, file_ord, hunk_ord, n, type, content, old_line, new_line, symbol_line) of the lines in hunks.

    ``symbol_line`` starts at the hunk's new start, or its old start where that is 0,
    or 1, and counts every line that is not deleted.
    """
    part = lambda k: F.regexp_extract("line", _HUNK, k).cast("long")
    hunk = Window.partitionBy(*FILE, "hunk_ord").orderBy("n")
    before = hunk.rowsBetween(Window.unboundedPreceding, -1)
    d = marked.where("role in ('hunk', 'add', 'delete', 'context')")
    is_old, is_new = F.col("role").isin("delete", "context"), F.col("role").isin("add", "context")
    starts = F.first(F.when(F.col("role") == "hunk", F.struct(part(1).alias("o"), part(3).alias("w")))).over(hunk)
    d = d.withColumn("s", starts)
    seen_old, seen_new = (F.coalesce(F.sum(c.cast("long")).over(before), F.lit(0)) for c in (is_old, is_new))
    content = F.when(F.col("role").isin("add", "delete") | F.col("line").startswith(" "), F.substring("line", 2, 1 << 30)).otherwise(F.col("line"))
    first = F.coalesce(F.nullif(F.col("s.w"), F.lit(0)), F.nullif(F.col("s.o"), F.lit(0)), F.lit(1))
    d = d.select(
        *FILE, "hunk_ord", "n", F.col("role").alias("type"), content.alias("content"),
        F.when(is_old, F.col("s.o") + seen_old).alias("old_line"), F.when(is_new, F.col("s.w") + seen_new).alias("new_line"), (first + seen_new).alias("symbol_line"),
    )
    return d.where("type <> 'hunk'")


def patch_text(marked: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (pr, file_ord, patch): header lines, hunk headers and hunk lines of each file, every line ended by a line feed."""
    line, role = F.col("line"), F.col("role")
    shown = F.when(role == "hunk", line).when(role.isin("add", "delete"), line).when(role == "context", F.when(line == "", " ").otherwise(line))
    body = marked.where("role in ('hunk', 'add', 'delete', 'context')").groupBy(*FILE).agg(F.array_join(in_order(F.concat(shown, F.lit("\n")), F.col("n")), "").alias("body"))
    head = F.concat(F.array_join("header_lines", "\n"), F.lit("\n"))
    return files.join(body, FILE, "left").select(*FILE, F.concat(head, F.coalesce("body", F.lit(""))).alias("patch"))


def file_path(files: DataFrame) -> Column:
    """New path, else old path, else empty."""
    return F.coalesce(first_filled(F.col("new_path"), F.col("old_path")), F.lit(""))


def nested(files: DataFrame, hunks: DataFrame, lines: DataFrame) -> DataFrame:
    """``files`` with hunks: array<struct<header, old_start, ..., lines: array<struct<type, content, ...>>>>."""
    inner = lines.groupBy(*FILE, "hunk_ord").agg(in_order(F.struct("type", "content", "old_line", "new_line"), F.col("n")).alias("lines"))
    packed = hunks.join(inner, [*FILE, "hunk_ord"], "left").groupBy(*FILE).agg(in_order(F.struct("header", "old_start", "old_lines", "new_start", "new_lines", "lines"), F.col("hunk_ord")).alias("hunks"))
    return files.join(packed, FILE, "left")
