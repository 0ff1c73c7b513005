"""Formulas as SQL text: the same IEEE steps in every engine, so results agree to the last digit.

Literals carry an exponent, which makes them DOUBLE; plain decimals would be DECIMAL.
"""


def rounded(x: str, digits: int = 6) -> str:
    """Half-up rounding through scaled integers."""
    return f"(floor(({x}) * 1e{digits} + 5e-1) / 1e{digits})"


def byte(x: str) -> str:
    """A tone from 0 to 1 as an integer from 0 to 255, half up; nearly exact halves go up."""
    return f"CAST(floor(least(255e0, greatest(0e0, {x})) + 5e-1 + 1e-9) AS INT)"


def modulo(value: str, modulus: str) -> str:
    """The remainder with the modulus's sign."""
    return f"(((({value}) % ({modulus})) + ({modulus})) % ({modulus}))"


def wrap_signed(offset: str, spacing: str) -> str:
    """An offset as at most half a cell in either direction; no spacing, no offset."""
    wrapped = modulo(f"{offset} + {spacing} / 2e0", spacing)
    return f"(CASE WHEN {spacing} > 0e0 THEN {wrapped} - {spacing} / 2e0 ELSE 0e0 END)"


def cmyk(r: str = "r", g: str = "g", b: str = "b", a: str = "a") -> dict[str, str]:
    """Ink shares of an RGB colour; clear pixels have none, other alpha doesn't count."""
    v = {"c": f"({r} / 255e0)", "m": f"({g} / 255e0)", "y": f"({b} / 255e0)"}
    k = f"(1e0 - greatest({', '.join(v.values())}))"
    out = {i: f"CASE WHEN {a} = 0 OR {k} >= 999e-3 THEN 0e0 ELSE least(1e0, greatest(0e0, (1e0 - {x} - {k}) / (1e0 - {k}))) END" for i, x in v.items()}
    return out | {"k": f"CASE WHEN {a} = 0 THEN 0e0 WHEN {k} >= 999e-3 THEN 1e0 ELSE {k} END"}


def darkness(r: str = "r", g: str = "g", b: str = "b", a: str = "a") -> str:
    """One minus relative luminance (Rec. 709 weights); clear pixels are 0."""
    return f"CASE WHEN {a} = 0 THEN 0e0 ELSE 1e0 - (2126e-4 * {r} + 7152e-4 * {g} + 722e-4 * {b}) / 255e0 END"


def threshold(v: str, t: str) -> str:
    """Tone above a threshold, stretched to 0..1."""
    return f"CASE WHEN {v} < {t} THEN 0e0 WHEN {t} >= 999e-3 THEN 1e0 ELSE ({v} - {t}) / (1e0 - {t}) END"


def grid(width: str, height: str, cells: str) -> dict[str, str]:
    """Columns and rows of a grid whose long edge has the given number of cells."""
    long = f"greatest(2e0, floor({cells} + 5e-1))"
    cols = f"CASE WHEN {width} >= {height} THEN {long} ELSE greatest(1e0, floor({long} * ({width} / {height}) + 5e-1)) END"
    rows = f"CASE WHEN {width} >= {height} THEN greatest(1e0, floor({long} / ({width} / {height}) + 5e-1)) ELSE {long} END"
    return {"cols": f"CAST({cols} AS INT)", "rows": f"CAST({rows} AS INT)"}


def number_text(x: str, cast: str = "STRING") -> str:
    """A number to 3 decimals without trailing zeros; minus zero is 0. Built from scaled integers."""
    n = f"CAST(floor(abs({x}) * 1e3 + 5e-1) AS BIGINT)"
    whole = f"CAST(CAST(floor({n} / 1000) AS BIGINT) AS {cast})"
    part = f"lpad(CAST({n} % 1000 AS {cast}), 3, '0')"
    text = f"concat(CASE WHEN {x} < 0 AND {n} > 0 THEN '-' ELSE '' END, {whole}, CASE WHEN {n} % 1000 = 0 THEN '' ELSE concat('.', regexp_replace({part}, '0+$', '')) END)"
    return text
