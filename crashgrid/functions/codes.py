"""Labels, letters and colours of accident codes, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from crashgrid import model


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(c: Column | str, table: dict) -> Column:
    """Value of a fixed table at ``c``; NULL when the key is absent or NULL.

    A CASE chain instead of a map keeps the expression inside generated code and
    never raises on unknown keys.
    """
    c = _column(c)
    branches = [(F.lit(k), F.lit(v)) for k, v in table.items()]
    (k0, v0), rest = branches[0], branches[1:]
    return reduce(lambda acc, kv: acc.when(c == kv[0], kv[1]), rest, F.when(c == k0, v0))


def code_label(c: Column | str, dim: str) -> Column:
    """``label (code)``; the bare code when it has no label; ``?`` when NULL."""
    c = _column(c)
    text = c.cast("string")
    labels = model.CODE_LABELS.get(dim)
    if labels is None:
        return F.coalesce(text, F.lit("?"))
    return F.coalesce(F.concat(lookup(c, labels), F.lit(" ("), text, F.lit(")")), text, F.lit("?"))


def _join_set_flags(texts: dict[str, str]) -> Column:
    return F.concat_ws(", ", *[F.when(F.col(f) == 1, F.lit(t)) for f, t in texts.items()])


def participant_labels() -> Column:
    """Labels of all participants whose flag is 1, in legend order."""
    return _join_set_flags(model.PARTICIPANT_LABELS)


def participant_letters(show: bool = True) -> Column:
    """Letters of all participants whose flag is 1; NULL while the symbols are hidden."""
    return _join_set_flags(model.PARTICIPANT_LETTERS) if show else F.lit(None).cast("string")


def participant_color() -> Column:
    """Colour of the first participant whose flag is 1."""
    flags = [F.when(F.col(f) == 1, F.lit(rgb)) for f, rgb in model.PARTICIPANT_COLORS.items()]
    return F.coalesce(*flags, F.lit(model.DEFAULT_COLOR))


def category_color(key: str) -> Column:
    """Point colour for one colouring key; ``BETEILIGUNG`` colours by participant."""
    if key == model.PARTICIPANT_GROUP:
        return participant_color()
    return F.coalesce(lookup(key, model.CODE_COLORS[key]), F.lit(model.DEFAULT_COLOR))


def legend_color(grp: Column | str, color: Column | str, active: Column | str) -> Column:
    """Legend swatch: the palette colour in the active group, white elsewhere."""
    grp, color, active = _column(grp), _column(color), _column(active)
    return F.when(grp == active, F.coalesce(color, F.lit(model.DEFAULT_COLOR))).otherwise(
        F.lit(model.INACTIVE_COLOR)
    )
