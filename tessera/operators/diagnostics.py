"""Diagnostics over build logs and lines of headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx

LOOK_AHEAD, BODY_AHEAD, ACCESS_BEHIND = 8, 20, 80
# A compiler names a file on a drive, a place in parentheses, a level with a code, and a
# message; the reflection tool a file, a line and a level between colons.
_NUMBER, _MESSAGE = "([0-9]+)", r"[ \t]*(\S.*)"
COMPILER = rf"^([A-Za-z]:[^()]+)[(]{_NUMBER}(?:,{_NUMBER})?[)]:[ \t]*((?:fatal )?error|warning)[ \t]*([A-Z]+[0-9]+):{_MESSAGE}"
REFLECTION = rf"^([A-Za-z]:[^:]+):{_NUMBER}:[ \t]*(Error|Warning):{_MESSAGE}"


def log_diagnostics(lines: DataFrame) -> DataFrame:
    """lines(line_no, text) of a build log: compiler messages, then reflection ones, with
    file, line and column from 0, severity, source and message."""
    get = lambda p, i: F.regexp_extract("text", p, i)
    at = lambda c: F.greatest(F.coalesce(c.try_cast("int"), F.lit(1)) - 1, F.lit(0))
    severity = lambda c: F.when(F.lower(c).contains("warning"), "warning").otherwise("error")
    compiler = lines.where(F.col("text").rlike(COMPILER)).select(
        "line_no", get(COMPILER, 1).alias("file"), at(get(COMPILER, 2)).alias("line"), at(get(COMPILER, 3)).alias("column"),
        severity(get(COMPILER, 4)).alias("severity"), F.lit("MSVC").alias("source"), F.concat_ws(": ", get(COMPILER, 5), get(COMPILER, 6)).alias("message"),
    )
    reflection = lines.where(F.col("text").rlike(REFLECTION)).select(
        "line_no", get(REFLECTION, 1), at(get(REFLECTION, 2)), F.lit(0), severity(get(REFLECTION, 3)), F.lit("UHT"), get(REFLECTION, 4)
    )
    return compiler.union(reflection).withColumn("code", F.lit("BUILD"))


def carry_forward(lines: DataFrame, value, default, behind: int, keys: list[str], order: str) -> DataFrame:
    """lines with `carried`: the last non-null value of the `behind` lines before each."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-behind, -1)
    return lines.withColumn("carried", F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(default)))


def look_ahead(lines: DataFrame, value, ahead: int, keys: list[str], order: str) -> DataFrame:
    """lines with `ahead`: whether the condition holds in a line or the next ahead - 1."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, ahead - 1)
    return lines.withColumn("ahead", F.coalesce(F.bool_or(value).over(w), F.lit(False)))


def rule_diagnostics(lines: DataFrame) -> DataFrame:
    """Reflection rules over lines(path, line, text), line from 0: UHT001 macro and
    declaration disagree, UHT002 no generated body, UEBP001 callable without category,
    UEBP002 private read-write property without access."""
    w = Window.partitionBy("path").orderBy("line")
    text = tx.strip("text")
    window = F.collect_list(F.struct("line", text.alias("t"))).over(w.rowsBetween(0, LOOK_AHEAD + BODY_AHEAD))
    access = F.when(text.isin("public:", "protected:", "private:"), F.regexp_replace(text, ":", ""))
    marked = carry_forward(lines, access, "private", ACCESS_BEHIND, ["path"], "line")
    marked = marked.withColumn("after", window).where(text.rlike(r"^(UCLASS|USTRUCT|UENUM)(\(|$)|^(UFUNCTION|UPROPERTY)\("))
    # Running parenthesis depth over the look-ahead finds the line that closes the macro.
    count = lambda s, c: F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))
    head = F.slice("after", 1, LOOK_AHEAD)
    closes = F.aggregate(
        head, F.expr("named_struct('i', 0, 'depth', 0, 'open', false, 'end', cast(null as int))"),
        lambda s, x: F.struct(
            (s["i"] + 1).alias("i"), (s["depth"] + count(x["t"], "(") - count(x["t"], ")")).alias("depth"), (s["open"] | x["t"].contains("(")).alias("open"),
            F.coalesce(s["end"], F.when((s["open"] | x["t"].contains("(")) & (s["depth"] + count(x["t"], "(") - count(x["t"], ")") <= 0), s["i"])).alias("end"),
        ),
        lambda s: F.coalesce(s["end"], F.lit(0)),
    )
    marked = marked.withColumn("end", closes)
    macro = F.array_join(F.transform(F.slice("after", F.lit(1), F.col("end") + 1), lambda x: x["t"]), " ")
    following = F.slice("after", F.col("end") + 2, F.lit(LOOK_AHEAD + BODY_AHEAD))
    real = F.filter(following, lambda x: (x["t"] != "") & ~x["t"].startswith("//"))
    marked = marked.withColumn("macro", macro).withColumn("next", F.try_element_at(real, F.lit(1)))
    body = F.exists(
        F.filter("after", lambda x: (x["line"] >= F.col("next.line")) & (x["line"] < F.col("next.line") + BODY_AHEAD)),
        lambda x: x["t"].contains("GENERATED_BODY") | x["t"].contains("GENERATED_UCLASS_BODY"),
    )
    is_type, declared = text.rlike("^(UCLASS|USTRUCT|UENUM)"), F.col("next.t")
    agrees = F.when(text.startswith("UCLASS"), declared.contains("class ")).when(text.startswith("USTRUCT"), declared.contains("struct ")).otherwise(declared.contains("enum "))
    rules = (
        ("UHT001", "error", "line", is_type & F.col("next").isNotNull() & ~agrees),
        ("UHT002", "error", "next.line", is_type & F.col("next").isNotNull() & ~text.startswith("UENUM") & ~body),
        ("UEBP001", "hint", "line", text.startswith("UFUNCTION(") & F.col("macro").contains("BlueprintCallable") & ~F.col("macro").contains("Category")),
        ("UEBP002", "warning", "line", text.startswith("UPROPERTY(") & F.col("macro").contains("BlueprintReadWrite") & ~F.col("macro").contains("AllowPrivateAccess") & (F.col("carried") == "private")),
    )
    found = F.array_compact(F.array(*(F.when(hit, F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"), F.col(at).alias("line"))) for c, s, at, hit in rules)))
    return marked.select("path", F.explode(found).alias("d")).select("path", "d.line", "d.severity", "d.code")
