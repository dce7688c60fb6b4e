"""Space between neighbouring atoms of an equation, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and the space between them ---------------------------------
#: Characters of each class; all others are of class 1 (ordinary).
CLASSES = {
    2: "∫∑∏",
    3: "+-×÷±∓·∗∩∪∧∨⊕⊗∘",
    4: ":<=>≠≤≥≈≅≡∼∝→←↔⇒⇔∈∉⊂⊃⊆⊇⊥∥≪≫↦≒",
    5: "([{",
    6: ")]}",
    7: "*,",
}
#: Units of space by the class of the left atom (row) and of the atom itself (column).
SPACING = (
    (0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
    (0, 0, 1, 2, 3, 1, 1, 0, 1, 0),
    (0, 1, 3, 2, 3, 0, 0, 0, 1, 0),
    (0, 2, 0, 0, 0, 2, 0, 0, 2, 0),
    (0, 3, 3, 0, 0, 3, 0, 0, 3, 0),
    (0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
    (0, 0, 1, 2, 3, 0, 0, 0, 1, 0),
    (0, 1, 1, 0, 1, 1, 1, 1, 1, 0),
    (0, 1, 1, 2, 3, 1, 0, 1, 1, 0),
)
#: Hundredths of the font size that a unit of space takes.
UNIT = 7
# --------------------------------------------------------------------------------------------


def math_class(char: Column) -> Column:
    """The class of a character; null and unknown ones are ordinary."""
    out = F
    for k, chars in CLASSES.items():
        out = out.when(char.isin(*chars), F.lit(k))
    return out.otherwise(F.lit(1))


def edge_classes(text: Column) -> tuple[Column, Column]:
    """The classes of a text's first and last character that is no white space; ordinary for a blank text."""
    bare = F.regexp_replace(text, r"(?U)\s", "")
    return math_class(F.left(bare, F.lit(1))), math_class(F.right(bare, F.lit(1)))


def atom_space(left: Column, this: Column, size: Column) -> Column:
    """Space before an atom of class ``this`` behind one of class ``left`` at a font size; 0 for classes that the table lacks."""
    known = left.between(0, len(SPACING) - 1) & this.between(0, len(SPACING[0]) - 1)
    table = F.array(*(F.lit(v) for row in SPACING for v in row))
    units = F.when(known, F.try_element_at(table, (left * len(SPACING[0]) + this + 1).cast("int")))
    return size.cast("double") * (F.coalesce(units, F.lit(0)) * UNIT) / 100
