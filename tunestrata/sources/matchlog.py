"""Match logs: text lines that pair a song with the track it was matched to.

A line reads ``ERROR: <song track> artist  -  title  !=  artist  -  title``. In the log of
accepted pairs the same line starts with ``< ``. Other lines are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("song_id", "track_id", "song_artist", "song_title", "track_artist", "track_title")

# Two ids of 18 characters, then four texts; in each text the first separator wins.
_LINE = r"(?s)^(?:< )?ERROR: <(\S{18}) (\S{18})> (.*?)  -  (.*?)  !=  (.*?)  -  (.*)$"
_MARK = "\u0001"


def _prefix(accepted: bool) -> str:
    return "< ERROR: " if accepted else "ERROR: "


def _parts(value: Column) -> Column:
    """The six captured texts as an array: one run of the pattern per line.

    A line that does not match comes back whole, as an array of one.
    """
    marked = F.regexp_replace(value, F.lit(_LINE), F.lit(_MARK.join(f"${i}" for i in range(1, 7))))
    return F.split(marked, _MARK, -1)


def parse_match_log(lines: DataFrame, accepted: bool = False) -> DataFrame:
    """Lines (one string column ``value``) to six named strings; malformed lines drop out."""
    parts = lines.where(F.col("value").startswith(_prefix(accepted))).select(
        _parts(F.col("value")).alias("parts")
    )
    return parts.where(F.size("parts") == len(FIELDS)).select(
        *(F.col("parts")[i].alias(name) for i, name in enumerate(FIELDS))
    )


def malformed_lines(lines: DataFrame, accepted: bool = False) -> DataFrame:
    """Lines that carry the prefix but do not follow the pattern, for a look at the losses."""
    return lines.where(
        F.col("value").startswith(_prefix(accepted)) & ~F.col("value").rlike(_LINE)
    )


def parse_marked(lines: DataFrame, accepted: bool = False) -> DataFrame:
    """Every line as ``kind`` (``parsed``, ``malformed`` or ``other``) and, if parsed, its six strings.

    Stored once, both the parsed lines and the figures of the losses come from one scan of the log.
    """
    prefixed = F.coalesce(F.col("value").startswith(_prefix(accepted)), F.lit(False))
    marked = lines.select(prefixed.alias("prefixed"), F.when(prefixed, _parts(F.col("value"))).alias("parts"))
    fits = F.coalesce(F.size("parts") == len(FIELDS), F.lit(False))
    kind = F.when(fits, "parsed").when(F.col("prefixed"), "malformed").otherwise("other")
    return marked.select(kind.alias("kind"), *(F.when(fits, F.col("parts")[i]).alias(name) for i, name in enumerate(FIELDS)))


def losses(marked: DataFrame) -> DataFrame:
    """One row: ``n_other, n_malformed, n_parsed`` of a log read by ``parse_marked``."""
    return marked.agg(*(F.count_if(F.col("kind") == kind).alias(f"n_{kind}") for kind in ("other", "malformed", "parsed")))
