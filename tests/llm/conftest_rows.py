"""Plain versions that several tests compare with."""

import re
import string

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def as_rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def lower(text):
    return text.translate(LOWER)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
