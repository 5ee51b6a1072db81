"""Writers. Large results go out by Spark; small reports, of stated size, are written by the driver."""

from __future__ import annotations

import csv
import html
import os
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a report may have.
REPORT_ROWS = 1_000_000


def report_rows(df: DataFrame) -> list:
    """All rows of a report; an error beyond REPORT_ROWS."""
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report holds at most {REPORT_ROWS} rows; write the table by Spark")
    return rows


def _report(df: DataFrame) -> tuple[list[str], list[tuple]]:
    return df.columns, [tuple(r) for r in report_rows(df)]


def _folder_of(path: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)


def write_small_csv(df: DataFrame, path: str, bom: bool = False) -> str:
    """One CSV file with a header, also for an empty table; nulls are empty. bom: begins with the UTF-8 mark."""
    names, rows = _report(df)
    _folder_of(path)
    with open(path, "w", newline="", encoding="utf-8-sig" if bom else "utf-8") as f:
        out = csv.writer(f)
        out.writerow(names)
        out.writerows([["" if x is None else x for x in r] for r in rows])
    return path


def write_per_well(df: DataFrame, roster: list[tuple[str, str]], folder: str, suffix: str = "_traces", columns: list[str] | None = None, order: str = "ord") -> str:
    """folder/kind/well<suffix>.csv for each (kind, well) of the roster, a header alone where the well has no row.

    Rows go in order; the table is written by Spark, a file a well, and the files named by the driver.
    """
    columns = columns or [c for c in df.columns if c not in ("kind", "well", order)]
    staged = os.path.join(folder, ".staged")
    df.select("kind", "well", order, *columns).repartition("kind", "well").sortWithinPartitions("kind", "well", order).drop(order).write.mode("overwrite").partitionBy("kind", "well").option("header", True).csv(staged)
    for kind, well in roster:
        at = os.path.join(staged, f"kind={_partition(kind)}", f"well={_partition(well)}")
        target = os.path.join(folder, kind, f"{well}{suffix}.csv")
        _folder_of(target)
        parts = sorted(f for f in os.listdir(at) if f.startswith("part-")) if os.path.isdir(at) else []
        if len(parts) > 1:
            raise RuntimeError(f"{at} has {len(parts)} parts")
        if parts:
            os.replace(os.path.join(at, parts[0]), target)
        else:
            with open(target, "w", newline="", encoding="utf-8") as f:
                csv.writer(f, lineterminator="\n").writerow(columns)
    _remove(staged)
    return folder


def _partition(value: str) -> str:
    """As Spark names a partition's folder."""
    return "".join(f"%{ord(c):02X}" if c in '"#%\'*/:=?\\{[]^\x7f' or ord(c) < 32 else c for c in value) or "__HIVE_DEFAULT_PARTITION__"


def _remove(folder: str) -> None:
    import shutil

    shutil.rmtree(folder, ignore_errors=True)


def write_frame(df: DataFrame, folder: str, well: str, file: str, logical_file: int, frame: str) -> str:
    """A frame's scalar columns as CSV in a folder of its own well, file, logical file and frame."""
    from lithoflow.operators.columns import scalar_columns

    path = os.path.join(folder, well, file.split(".")[0], str(logical_file), frame)
    scalar_columns(df).write.mode("overwrite").option("header", True).csv(path)
    return path


def write_xlsx(df: DataFrame, path: str, sheet: str = "Sheet1") -> str:
    """A workbook of one sheet: a header row, numbers as numbers, all else as text. Only what any reader of OOXML needs."""
    names, rows = _report(df)
    if len(names) > 16_384 or len(rows) > 1_048_575:
        raise ValueError("a sheet holds 16,384 columns and 1,048,576 rows")

    def column(i: int) -> str:
        out = ""
        while i >= 0:
            out, i = chr(65 + i % 26) + out, i // 26 - 1
        return out

    def cell(i: int, j: int, x) -> str:
        if x is None:
            return ""
        at = f'r="{column(j)}{i}"'
        if isinstance(x, (int, float)) and not isinstance(x, bool):
            return f"<c {at}><v>{x}</v></c>"
        return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(str(x))}</t></is></c>'

    lines = [f'<row r="{i}">{"".join(cell(i, j, x) for j, x in enumerate(r))}</row>' for i, r in enumerate([tuple(names), *rows], 1)]
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{"".join(lines)}</sheetData></worksheet>',
    }
    _folder_of(path)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, head + body)
    return path


def render_table(df: DataFrame, path: str, font: str = "SimHei", size: int = 10, dpi: int = 300) -> str:
    """A picture of the table; HTML beside it where no plotting library is installed. Returns the file written."""
    names, rows = _report(df)
    _folder_of(path)
    try:
        import matplotlib
    except ModuleNotFoundError:
        target = os.path.splitext(path)[0] + ".html"
        cells = lambda tag, r: "".join(f"<{tag}>{html.escape('' if x is None else str(x))}</{tag}>" for x in r)
        body = "".join(f"<tr>{cells('td', r)}</tr>" for r in rows)
        with open(target, "w", encoding="utf-8") as f:
            f.write(f'<!DOCTYPE html><meta charset="utf-8"><style>td,th{{border:1px solid;padding:4px;text-align:center;font:{size}pt {font},sans-serif}}table{{border-collapse:collapse}}</style><table><tr>{cells("th", names)}</tr>{body}</table>')
        return target
    matplotlib.use("Agg")
    from matplotlib import pyplot as plt

    plt.rcParams["font.sans-serif"] = [font]
    fig, ax = plt.subplots(figsize=(max(8, 0.6 * len(names)), 0.6 * max(1, len(rows))))
    ax.axis("off")
    drawn = ax.table(cellText=[r[1:] for r in rows], rowLabels=[r[0] for r in rows], colLabels=names[1:], cellLoc="center", loc="center")
    drawn.auto_set_font_size(False)
    drawn.set_fontsize(size)
    fig.savefig(path, dpi=dpi, bbox_inches="tight")
    plt.close(fig)
    return path


def prevalence_report(table: DataFrame) -> DataFrame:
    """Prevalence as tab-separated lines, sorted."""
    first = table.columns[0]
    return table.orderBy(first).select(F.concat_ws("\t", *[F.col(c).cast("string") for c in table.columns]).alias("line"))
