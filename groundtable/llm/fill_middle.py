"""Fill-in-the-middle transformation of texts by one counted match a row.

``regexp_count`` gives the number n of units of a text, counted by ``block`` units and then singly in what
is left, so the matches it lists stay few.  Two numbers drawn from the row's id cut the text after a and b units, and a pattern made for the row, ``\\A(unit{a}+)(unit{b-a}+)(.*+)\\z``, captures
prefix, middle and suffix in one match: its groups are possessive, so nothing is ever tried twice.
The same replacement writes the output, and its inverse rebuilds the text.

Forms: ``plain`` is the text itself, ``psm`` is ``<P>``prefix``<S>``suffix``<M>``middle, and ``spm`` is
``<S>``suffix``<P>``prefix``<M>``middle.  A text that is empty or holds a marker stays plain.  A marker
starts with its only ``<``, so none arises where a piece meets a marker, and the inverse is exact.

* All draws come from the SHA-256 of ``<seed>:<id>``; reruns and any partitioning agree.
* Null text counts as empty.  A null id draws as an empty string.  Rows that repeat an id draw alike, each
  for its own text; repeated rows stay.  An empty table gives an empty result.
* Texts are matched whole, whatever their length.  Other columns are ignored, whatever their names.
* Units follow one another without gaps from the start of a text, as code points do; what follows the last
  unit belongs to the suffix.
* No shuffle and no Python take part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKERS = ("<P>", "<S>", "<M>")


@dataclass(frozen=True)
class FillParams:
    """``unit`` is the pattern that is counted, ``block`` at a time; shares are in percent, of all texts and of those not plain."""

    seed: str = "1"
    unit: str = "(?s:.)"
    block: int = 1024
    plain_from: int = 90
    spm_below: int = 20


def _draw(digest: Column, number: int) -> Column:
    """The ``number``-th group of eight hex digits as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * number + 1, 8), 16, 10).cast("long")


def _count(text: Column, params: FillParams) -> Column:
    """The number of units at the start of ``text``."""
    blocks = rf"\G(?:(?:{params.unit}){{{params.block}}}+)"
    rest = F.regexp_replace(text, rf"\A{blocks[2:]}*+", "")
    return (F.regexp_count(text, F.lit(blocks)) * params.block + F.regexp_count(rest, F.lit(rf"\G(?:{params.unit})"))).cast("long")


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: FillParams = FillParams()) -> DataFrame:
    """(id, n, form, prefix_units, middle_units, output): one row a text; the units are null where it stays plain."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    name = F.concat(F.lit(f"{params.seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    counted = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.sha2(name, 256).alias("digest")).withColumns(
        {"n": _count(F.col("text"), params), **{f"h{i + 1}": _draw(F.col("digest"), i) for i in range(4)}}
    )
    plain = (F.col("n") == 0) | (F.col("h3") % 100 >= params.plain_from)
    for marker in MARKERS:
        plain = plain | F.contains("text", F.lit(marker))
    first, second = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    drawn = counted.select(
        "id",
        "text",
        "n",
        F.when(plain, "plain").when(F.col("h4") % 100 < params.spm_below, "spm").otherwise("psm").alias("form"),
        F.least(first, second).alias("a"),
        F.greatest(first, second).alias("b"),
    )
    unit = params.unit.replace("%", "%%")
    cut = F.format_string(rf"\A((?:{unit}){{%d}}+)((?:{unit}){{%d}}+)((?s:.)*+)\z", "a", F.col("b") - F.col("a"))
    order = F.when(F.col("form") == "spm", "<S>$3<P>$1<M>$2").otherwise("<P>$1<S>$3<M>$2")
    moved = F.col("form") != "plain"
    return drawn.select(
        F.col("id").alias(id_col),
        "n",
        "form",
        F.when(moved, F.col("a")).alias("prefix_units"),
        F.when(moved, F.col("b") - F.col("a")).alias("middle_units"),
        F.when(moved, F.regexp_replace(F.col("text"), cut, order)).otherwise(F.col("text")).alias("output"),
    )


def restore_text(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from."""
    psm = F.regexp_replace(output, r"\A<P>((?s:.)*?)<S>((?s:.)*?)<M>((?s:.)*+)\z", "$1$3$2")
    spm = F.regexp_replace(output, r"\A<S>((?s:.)*?)<P>((?s:.)*?)<M>((?s:.)*+)\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
