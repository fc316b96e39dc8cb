"""The words that prescriptions are laid out with, and patterns made of them.

Every pattern of the parsers is made here from the tables below, so that a
label, a footer or a unit stands in one place.
"""

from __future__ import annotations

import re

#: Results depend on these words. A blank in a word stands for any white space, beside a sign for none, too.
FIELDS = {
    "medicine": ("Medicine",), "form": ("Form", "Brand / Form"), "strength": ("Strength",), "both": ("Dose and Duration", "Dose & Duration", "Dose Duration"),
    "dose": ("Dose",), "schedule": ("Schedule",), "duration": ("Duration",), "instructions": ("Instructions", "Instruction"),
}
#: Lines that end the prescription's part of a page.
FOOTERS = ("Advice", "Investigations", "Signature", "Sample", "This is sample", "Not valid", "Do not use")
#: What stands before a medicine and is no part of it.
LEADS = ("Rx", "R/x", "Medication", "Medications", "Drug", "Drugs")
#: The headings after which prescriptions begin.
MARKERS = ("Rx", "R/x", "Medicine", "Medicines", "Prescription ( Rx )")
#: Forms that begin the next medicine when a capital follows.
NEXT_FORMS = ("Tab", "Cap", "Syrup", "Oint", "Lotion", "Drop", "Spray", "Sachet")
#: Labels of a table's columns as scanners read them.
COLUMNS = {"name": ("N AME", "N AE", "N ME", "N E", "AME", "AE", "ME", "E"), "dose": ("DOSE",), "duration": ("DURATION",), "instructions": ("INSTRUCTIONS", "INSTRUCTION")}
MISREAD_NAMES = ("NAME", "NME", "AME", "NAE", "NAM")
#: Units of quantities, strengths and time.
QUANTITIES = ("tab", "tabs", "tablet", "tablets", "cap", "caps", "capsule", "capsules", "ml", "drop", "drops", "puff", "puffs", "unit", "units", "spoonful", "spoonfuls", "tsp", "teaspoon", "teaspoons")
STRENGTHS = ("mg", "mcg", "g", "gm", "ml", "iu", "unit", "units", "%")
TIMES = ("d", "day", "days", "wk", "wks", "week", "weeks", "mo", "mos", "month", "months")
WHOLE_TIMES = ("DAY", "DAYS", "WEEK", "WEEKS", "MONTH", "MONTHS")
#: Remarks that end a medicine's name.
REMARKS = ("After food", "Before breakfast", "At night", "Before sleep")
REMARK_WORDS = ("syrup", "tablet", "capsule", "cough", "pain", "fever")
#: What may stand between a label and its value, and what is trimmed at edges.
SIGNS = r"\s*[:;.-]?\s*"
MAYBE = r"\s*"
ITEM = r"\d+\s*[\.)-]?\s*"
SHORT_ITEM = r"\d{1,2}\s*[\.)-]?\s*"


def word(w: str, gap: str = r"\s+") -> str:
    """A word's pattern."""
    parts = w.split()
    out = re.escape(parts[0])
    for one, two in zip(parts, parts[1:]):
        out += (gap if one.isalnum() and two.isalnum() else r"\s*") + re.escape(two)
    return out


def any_of(*words: str, gap: str = r"\s+") -> str:
    """Any of the words; longer ones first, so that none is cut short."""
    return "(?:" + "|".join(word(w, gap) for w in sorted(words, key=len, reverse=True)) + ")"


def fields(*names: str) -> str:
    return any_of(*(w for n in names for w in FIELDS[n]), gap=MAYBE)


def labelled(*names: str) -> str:
    """Any of the fields' labels, up to the sign."""
    return rf"\b{fields(*names)}\s*:"


def footer(*more: str, without: tuple[str, ...] = ()) -> str:
    return any_of(*(f for f in (*FOOTERS, *more) if f not in without))
