"""Data-loss scans of repositories and of workbook cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scans
from ..functions import text as T


def repository(files: DataFrame, allowed_parts: tuple[str, ...] = (), allowed_names: tuple[str, ...] = ()) -> DataFrame:
    """(path, category, pattern, start, end, line_no, match) of files (path, text): for each pattern the first match that counts. Files of
    other suffixes, below allowed folders or of allowed names are not scanned. Every hit is returned; a report may show the first ones."""
    path = F.replace("path", F.lit("\\"), F.lit("/"))
    inside = F.lit(False)
    for part in allowed_parts:
        inside = inside | F.concat(F.lit("/"), path).contains(f"/{part}/")
    name = F.element_at(F.split(path, "/"), -1)
    scanned = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*scans.SUFFIXES) & ~inside & ~name.isin(*allowed_names)
    return files.where(scanned).select("path", F.explode(scans.repository_hits("text")).alias("h")).select("path", "h.*")


def cells(grid: DataFrame, patterns=T.DLP) -> DataFrame:
    """(path, sheet, row, col, category, value) of each match in the cells (path, sheet, row, col, text); values are masked. A telephone
    number has seven digits or more."""

    def hits(kind: str, pattern: str):
        found = F.filter(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda m: m != "")
        if kind == "PHONE":
            found = F.filter(found, lambda m: F.length(F.regexp_replace(m, r"\D", "")) >= 7)
        return F.transform(found, lambda m: F.struct(F.lit(kind).alias("category"), T.snippet(m).alias("value")))

    filled = grid.where("text <> ''")
    return filled.select("path", "sheet", "row", "col", F.explode(F.flatten(F.array(*[hits(k, p) for k, p in patterns]))).alias("h")).select("path", "sheet", "row", "col", "h.*")
