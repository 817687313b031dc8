"""Security identifiers: format and check digit, inside the JVM."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISIN = "^[A-Z]{2}[A-Z0-9]{9}[0-9]$"


def isin_valid(c: Column) -> Column:
    """True where the text is an ISIN whose last digit is right (letters count as 10 to 35, Luhn from the right). Null: false."""
    digits = []
    for i in range(1, 13):  # twelve plain expressions, which compile, where a lambda over the letters would not
        x = F.substring(c, i, 1)
        digits.append(F.when(x >= "A", (F.ascii(x) - 55).cast("string")).otherwise(x))
    return F.coalesce(F.when(c.rlike(ISIN), F.call_function("luhn_check", F.concat(*digits))), F.lit(False))
