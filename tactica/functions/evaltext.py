"""Values out of an engine's text output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def search_centipawn(text: Column) -> Column:
    """The last score: centipawns, or 10000 for a mate by the side to move and -10000 else; null if none."""
    found = F.regexp_extract_all(text, F.lit("score (?:cp|mate) -?[0-9]+"), F.lit(0))
    last = F.get(F.reverse(found), F.lit(0))
    n = F.regexp_extract(last, "(-?[0-9]+)$", 1).cast("int")
    return F.when(last.contains("score mate"), F.when(n > 0, 10000).otherwise(-10000)).when(last.isNotNull(), n)


def eval_columns(text: Column, search: Column, last: Column | None = None) -> dict[str, Column]:
    """SF_Material, SF_Positional, SF_Final_Eval, SF_Last_Move_CP of one evaluation text and the search after
    the last move, all nullable doubles. Of several rows of the used bucket, the last with numbers counts.

    In check, the final evaluation is the search's centipawns from the mover's side; otherwise it is
    pawns from White's side.
    """
    number = lambda cells, i: F.regexp_replace(F.get(cells, F.lit(i)), " ", "").try_cast("double")
    rows = F.transform(F.filter(F.split(text, "\n"), lambda line: line.contains("<-- this bucket is used")), lambda line: F.split(line, "\\|"))
    # the first number stays even where the second cannot be read
    some = F.filter(rows, lambda c: (F.size(c) >= 5) & number(c, 2).isNotNull())
    both = F.filter(some, lambda c: number(c, 3).isNotNull())
    in_check = text.contains("Final evaluation: none (in check)")
    line = F.get(F.reverse(F.filter(F.split(text, "\n"), lambda x: x.contains("Final evaluation") & x.contains("(white side)"))), F.lit(0))
    final = F.regexp_extract(line, "([+-]?[0-9]+\\.[0-9]+)", 1).try_cast("double")
    return {
        "SF_Material": F.when(~in_check, number(F.get(F.reverse(some), F.lit(0)), 2)), "SF_Positional": F.when(~in_check, number(F.get(F.reverse(both), F.lit(0)), 3)),
        "SF_Final_Eval": F.when(in_check, search_centipawn(search).cast("double")).otherwise(final),
        "SF_Last_Move_CP": search_centipawn(search if last is None else last).cast("double"),
    }
