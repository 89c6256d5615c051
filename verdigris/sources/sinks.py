"""Writers: JSON lines, metric tables as CSV, JSON and Markdown, pivots, galleries."""

from __future__ import annotations

import base64
import html
import json
import math
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import text_or_empty

#: The columns of a metric table, those that Markdown shows, and the same of a slice table.
METRIC_COLUMNS = (
    "model", "split", "condition", "n", "n_real", "n_fake", "acc", "auroc", "precision_fake", "recall_fake", "fpr", "mean_pred", "threshold",
)
SHOWN_COLUMNS = ("model", "condition", "n", "acc", "auroc", "precision_fake", "recall_fake", "fpr")
SLICE_COLUMNS = (
    "feature", "value", "n", "n_real", "n_fake", "acc", "auroc", "fpr", "fnr", "mean_pred", "real_prevalence", "fake_prevalence",
    "prevalence_gap", "delta_fpr", "delta_fnr", "generator_count", "high_fnr_generators", "shortcut_candidate", "blind_spot_candidate",
)
SHOWN_SLICE_COLUMNS = (
    "feature", "value", "n", "n_real", "n_fake", "auroc", "fpr", "fnr", "prevalence_gap", "shortcut_candidate", "blind_spot_candidate",
)
#: Fixed value: the cards of a gallery that is one page.
EMBEDDED_CARDS = 80


def json_lines(df: DataFrame, path: str) -> None:
    """One object a row; nulls are written."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def metric_texts(df: DataFrame, columns: Sequence[str] = METRIC_COLUMNS) -> DataFrame:
    """The columns as text: numbers with four digits, nothing for null and for columns that are missing."""
    kinds = dict(df.dtypes)
    out = []
    for c in columns:
        if c not in kinds:
            out.append(F.lit("").alias(c))
        else:
            out.append((text_or_empty(F.col(c)) if kinds[c] in ("double", "float") else F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c))
    return df.select(*out)


def metric_csv(df: DataFrame, path: str, columns: Sequence[str] = METRIC_COLUMNS) -> None:
    metric_texts(df, columns).write.mode("overwrite").option("header", "true").option("emptyValue", "").csv(path)


def metric_json(df: DataFrame, path: str) -> None:
    """A report of a few rows, written by the driver."""
    Path(path).write_text(json.dumps([r.asDict(True) for r in df.collect()], ensure_ascii=False, indent=2), encoding="utf-8")


def markdown(df: DataFrame, columns: Sequence[str] = SHOWN_COLUMNS, empty: str = "") -> str:
    """A report of a few rows as a Markdown table."""
    rows = metric_texts(df, columns).collect()
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(r[c] or empty for c in columns) + " |" for r in rows)]) + "\n"


def slice_csv(df: DataFrame, path: str) -> None:
    """A slice table with all its columns, numbers in full; nothing for null."""
    df.select(*SLICE_COLUMNS).write.mode("overwrite").option("header", "true").option("emptyValue", "").csv(path)


def slice_markdown(df: DataFrame) -> str:
    """The shown columns of a slice table, a dash for null; flags as True and False."""
    flags = [c for c, kind in df.dtypes if kind == "boolean"]
    return markdown(df.withColumns({c: F.initcap(F.col(c).cast("string")) for c in flags}), SHOWN_SLICE_COLUMNS, "—")


def group_csv(stats: DataFrame, path: str) -> None:
    stats.orderBy("group_type", "group_value").write.mode("overwrite").option("header", "true").csv(path)


def pivot_markdown(df: DataFrame, conditions: Sequence[str], models: Sequence[str] = ()) -> str:
    """Models by conditions, in the orders given (models that are not named come last, by name), as acc / auroc."""
    from ..operators.groups import pivot_metrics

    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(m) for m in models]).cast("array<string>"), F.col("model")), F.lit(0)), F.lit(len(models) + 1))
    rows = pivot_metrics(df, conditions).orderBy(place, "model").collect()
    shown = lambda x: "" if x is None else f"{x:.4f}"
    lines = ["| model | " + " | ".join(conditions) + " |", "|" + "---|" * (len(conditions) + 1)]
    for r in rows:
        lines.append(f"| {r['model']} | " + " | ".join(f"{shown(r[f'{c}_acc'])} / {shown(r[f'{c}_auroc'])}" for c in conditions) + " |")
    return "\n".join(lines) + "\n"


def feature_cache(df: DataFrame, path: str) -> None:
    df.orderBy("path").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def tensors(df: DataFrame, path: str) -> None:
    """Feature vectors and labels as Parquet."""
    df.write.mode("overwrite").parquet(path)


def new_only(df: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows that an earlier run has not written."""
    return df.join(existing.select(key).distinct(), key, "left_anti")


def _cards(worst: DataFrame) -> dict[str, list[dict]]:
    """The worst errors (a few rows, ranked by Spark) by kind, in their order."""
    cards: dict[str, list] = {"FP": [], "FN": []}
    for r in worst.orderBy("error_type", "place").collect():
        told = r.asDict()
        cards[r["error_type"]].append(
            {"etype": r["error_type"], "path": r["image_path"], "pred": r["pred"], "label": r["label"]}
            | {c: told[c] for c in ("condition", "generator", "thumb") if c in told}
        )
    return cards


def _figure(card: dict, picture: str | None) -> str:
    """A card; `picture` is what its image is read from (no image at all where thumbnails were not asked for)."""
    path = html.escape(card["path"])
    shown = ""
    if "thumb" in card:
        shown = f'<img src="{picture}" alt="error">' if picture else f'<div class="meta">[image not found: {path}]</div>'
    more = "".join(f" · {html.escape(str(card[c] or ''))}" for c in ("condition", "generator") if c in card)
    return (
        f'<figure data-etype="{card["etype"]}" data-path="{path}" data-pred="{card["pred"]}">{shown}'
        f"<figcaption>{path} {card['pred']:.4f}{more}</figcaption></figure>"
    )


def _meta(cards: dict[str, list[dict]], threshold: float, joined: int) -> str:
    return f"threshold={threshold} · FP={len(cards['FP'])} · FN={len(cards['FN'])} · joined={joined}"


def _script(cards: dict[str, list[dict]]) -> str:
    bare = {kind: [{k: v for k, v in c.items() if k != "thumb"} for c in own] for kind, own in cards.items()}
    return "<script>const cards = " + json.dumps(bare).replace("<", "\\u003c") + ";</script>"


def gallery_html(worst: DataFrame, title: str, threshold: float, joined: int) -> str:
    """A page of the worst errors, with its cards as JSON; pictures are inside the page where `worst` has their bytes (`thumb`, PNG)."""
    cards = _cards(worst)
    picture = lambda c: c.get("thumb") and "data:image/png;base64," + base64.b64encode(c["thumb"]).decode()
    shown = "".join(_figure(c, picture(c)) for own in cards.values() for c in own)
    return f"<!doctype html><title>{html.escape(title)}</title><p>{_meta(cards, threshold, joined)}</p>{shown}{_script(cards)}"


def gallery_pages(worst: DataFrame, title: str, threshold: float, joined: int, out: str, page_size: int = 40) -> list[str]:
    """The same as a folder: index.html with all cards as JSON and the first page, page-2.html and so on, and thumbs/; the pages' paths."""
    cards = _cards(worst)
    every = [c for own in cards.values() for c in own]
    folder = Path(out)
    (folder / "thumbs").mkdir(parents=True, exist_ok=True)
    figures = []
    for k, card in enumerate(every):
        name = f"thumbs/{k:05d}.png" if card.get("thumb") else None
        if name:
            (folder / name).write_bytes(card["thumb"])
        figures.append(_figure(card, name))
    names = ["index.html", *(f"page-{k}.html" for k in range(2, math.ceil(len(every) / page_size) + 1))]
    links = " ".join(f'<a href="{n}">{k}</a>' for k, n in enumerate(names, 1))
    head = f"<!doctype html><title>{html.escape(title)}</title><p>{_meta(cards, threshold, joined)}</p><p>{links}</p>"
    for k, name in enumerate(names):
        body = "".join(figures[k * page_size : (k + 1) * page_size])
        (folder / name).write_text(head + body + (_script(cards) if k == 0 else ""), encoding="utf-8")
    return [str(folder / n) for n in names]


def gallery(worst: DataFrame, title: str, threshold: float, joined: int, out: str, layout: str = "auto", page_size: int = 40) -> list[str]:
    """Writes a gallery to `out` (a name.html): one page, or for more than 80 cards a folder of pages beside it; the paths of its pages."""
    if layout not in ("auto", "embedded", "paged"):
        raise ValueError(f"unknown layout {layout}")
    if layout == "paged" or layout == "auto" and worst.count() > EMBEDDED_CARDS:
        return gallery_pages(worst, title, threshold, joined, str(Path(out).with_suffix("")), page_size)
    Path(out).parent.mkdir(parents=True, exist_ok=True)
    Path(out).write_text(gallery_html(worst, title, threshold, joined), encoding="utf-8")
    return [out]


def report(sections: dict[str, str]) -> str:
    return "\n".join(f"## {head}\n\n{body}" for head, body in sections.items())
