"""Units and currencies as written by people, read into unit ids and currency codes.

Plain Python on single strings, cached: a column holds few distinct spellings, and callers hand over Arrow batches.
(As Column expressions the same rules make plans too large for code generation.)
"""
from __future__ import annotations

import re
from functools import lru_cache

# Spellings of currencies (first match wins; GBp is told from GBP by case), of scales and of share units.
PENCE_EXACT_CASE = "GBp"
CURRENCY_WORDS = [
    ("GBX", r"gbx|pence|gbp/100|펜스"),
    ("HKD", r"hkd|hk\$|hong kong dollars?|홍콩\s*달러"),
    ("USD", r"usd|us\$|us dollars?|dollars?|미국\s*달러|달러|\$"),
    ("JPY", r"jpy|jp¥|yen|엔화|엔"),
    ("CNY", r"cny|cn¥|rmb|yuan|위안화|위안"),
    ("EUR", r"eur(?:os?)?|€|유로"),
    ("GBP", r"gbp|£|sterling|파운드"),
    ("KRW", r"krw|₩|won|원화|원"),
]
SCALE_WORDS = {
    "currency_amount": ["", "currency_amount", "plain"],
    "thousand": ["thousand", "thousands", "k", "'000", "’000", "000", "천"],
    "million": ["million", "millions", "m", "mn", "mm", "백만"],
    "hundred_million": ["hundred_million", "hundred million", "100mn", "100m", "100 million", "억"],
    "billion": ["billion", "billions", "bn", "십억"],
}
SHARE_WORDS = {
    "percent_observed": ["percent_observed", "%", "％", "pct", "percent", "per cent", "퍼센트", "프로"],
    "ratio": ["ratio", "fraction", "fractions", "fraction of 1", "fraction of one", "decimal", "비율", "소수", "as fraction"],
    "basis_point": ["basis_point", "bp", "bps", "b.p.", "b.p", "basis point", "basis points", "‱", "만분율", "베이시스 포인트"],
    "permille": ["permille", "permil", "per mille", "per mil", "‰", "천분율"],
}
#: Words around a number that say nothing of its unit.
TEXT_FILLERS = r"약|연율|연|annualised|annualized|approx\.?|about|circa|ca\.|\bas an?\b"
#: A note speaks of values without a unit if one of these stands in it.
NOTE_OF_BLANKS = r"blank|unlabell?ed|without a unit|without one|no unit|not given|미기재|없으면|없는 경우|비어"
NOTE_SHARE_WORDS = [
    ("basis_point", r"basis points?|\bbps?\b|b\.p\.|만분율|‱"),
    ("permille", r"per ?mille|permil\b|천분율|‰"),
    ("ratio", r"fractions?|\bratios?\b|소수|비율로"),
    ("percent_observed", r"per ?cent|\bpct\b|%|％|퍼센트|백분율"),
]
NOTE_SCALE_WORDS = [
    ("hundred_million", r"hundred millions?|100 ?mn|억"),
    ("billion", r"billions?|\bbn\b|십억"),
    ("million", r"millions?|\bmn\b|백만"),
    ("thousand", r"thousands?|'000|천"),
]


_CURRENCIES = [(code, re.compile(words)) for code, words in CURRENCY_WORDS]
_ANY_CURRENCY = re.compile("|".join(words for _, words in CURRENCY_WORDS))
_SHARES = {w: unit for unit, words in SHARE_WORDS.items() for w in words} | {"percent observed": "percent_observed", "basis point": "basis_point"}
_SCALES = {w: unit for unit, words in SCALE_WORDS.items() for w in words} | {"currency amount": "currency_amount"}
_NUMBER = re.compile(r"^([^0-9]*?)[-+−]?\s*[0-9][0-9,]*(?:\.[0-9]+)?(.*)$", re.S)
_FILLERS = re.compile(TEXT_FILLERS, re.I)
_BLANKS = re.compile(NOTE_OF_BLANKS)
_NOTE_SHARES = [(unit, re.compile(words)) for unit, words in NOTE_SHARE_WORDS]
_NOTE_SCALES = [(unit, re.compile(words)) for unit, words in NOTE_SCALE_WORDS]


def _tidy(text: str) -> str:
    return re.sub(r"[\s_()\[\]]+", " ", text.lower()).strip()


@lru_cache(1 << 16)
def currency_named(text: str | None) -> str | None:
    """The currency that stands in a text; None if none does."""
    if not text:
        return None
    if PENCE_EXACT_CASE in text:
        return "GBX"
    low = text.lower()
    return next((code for code, words in _CURRENCIES if words.search(low)), None)


@lru_cache(1 << 16)
def share_unit(text: str | None) -> str | None:
    """A unit of shares (percent, ratio, ...) from its spelling; None if it is none."""
    return _SHARES.get(_tidy(text)) if text else None


@lru_cache(1 << 16)
def amount_unit(text: str | None) -> str | None:
    """A scale of amounts from its spelling, any currency in it aside; None if it is none. Pence have no scale."""
    if not text:
        return None
    named = currency_named(text)
    if named == "GBX":
        return "currency_amount"
    bare = re.sub(r"\s+", " ", _ANY_CURRENCY.sub(" ", _tidy(text))).strip()
    return _SCALES.get(bare) if bare or named else None


def unit_in_text(text: str | None) -> str | None:
    """What stands around the first number of a text, fillers aside; None where no number or nothing else stands in it."""
    m = _NUMBER.match(text) if text else None
    if not m:
        return None
    around = re.sub(r"[()\[\]]", " ", _FILLERS.sub(" ", f"{m[1]} {m[2]}"))
    return re.sub(r"\s+", " ", around).strip() or None


@lru_cache(1 << 12)
def note_units(note: str | None) -> tuple[str | None, str | None, str | None]:
    """What a source's note gives to values without a unit: share unit, scale of amounts, their currency.

    A scale is given only with its currency; a note that doesn't speak of blank units gives nothing.
    """
    low = (note or "").lower()
    if not _BLANKS.search(low):
        return None, None, None
    share = next((unit for unit, words in _NOTE_SHARES if words.search(low)), None)
    currency = currency_named(note)
    cash = re.sub("천분율|만분율|백분율", " ", low)
    scale = next((unit for unit, words in _NOTE_SCALES if words.search(cash)), "currency_amount")
    if currency is None:
        scale = None
    return share, "currency_amount" if currency == "GBX" else scale, currency


def stated(share: bool, unit: str | None, currency: str | None, text: str | None, note: str | None) -> tuple[str, str, str] | None:
    """What one row states of its unit: (unit_id, currency, basis), or None.

    The unit column goes first; where it is null or 'number', the text; where it is null and no text names a unit, the
    note. A currency named with the unit goes before the currency column; an amount without any has no known unit.
    """
    read = share_unit if share else amount_unit
    plain = unit is not None and unit.strip().lower() == "number"
    words, basis, kind, named = None, None, None, None
    if unit is not None and not plain and (kind := read(unit.strip())):
        words, basis = unit, "column"
    elif (unit is None or plain) and (words := unit_in_text(text)) and (kind := read(words)):
        basis = "text"
    elif unit is None:
        s, a, named = note_units(note)
        kind, basis = (s if share else a), "note"
    if kind is None:
        return None
    if share:
        return kind, "none", basis
    named = named if basis == "note" else currency_named(words)
    named = named or currency_named(currency)
    return None if named is None else ("currency_amount" if named == "GBX" else kind, named, basis)
