"""The patterns on offer, in Java's dialect: ASCII word boundaries and digits, explicit white space."""

from __future__ import annotations

from .fold import SPACE

#: Word boundaries between ASCII letters, digits, underscore and all else.
B = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
_S = SPACE

#: Id, pattern, validator.
PRESETS: dict[str, tuple[str, str | None]] = {
    "cpf": (rf"{B}[0-9]{{3}}\.?[0-9]{{3}}\.?[0-9]{{3}}-?[0-9]{{2}}{B}", "cpf"),
    "cnpj": (rf"{B}(?:[0-9]{{2}}\.?[0-9]{{3}}\.?[0-9]{{3}}/?[0-9]{{4}}-?[0-9]{{2}}|[0-9A-Z]{{2}}\.[0-9A-Z]{{3}}\.[0-9A-Z]{{3}}/[0-9A-Z]{{4}}-[0-9]{{2}}){B}", "cnpj"),
    "pis": (rf"{B}[0-9]{{3}}\.?[0-9]{{5}}\.?[0-9]{{2}}-?[0-9]{B}", "pis"),
    "email": (rf"{B}[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2,}}{B}", None),
    "telefone": (rf"(?:\+55{_S}?)?(?:\([0-9]{{2}}\){_S}?|{B}[0-9]{{2}}(?:{_S}|-))9?[0-9]{{4}}(?:{_S}|-)[0-9]{{4}}{B}", None),
    "cartao": (rf"{B}(?:[0-9][ .-]?){{12,18}}[0-9]{B}", "cartao"),
    "senha": (rf"{B}(?:senha|password|passwd|pwd){_S}*[:=]{_S}*[^\s  -     　﻿]+", None),
}

#: Cheap tests that hold for every text with a match, so that most texts are scanned once.
LIKELY: dict[str, str] = {
    "cpf": r"[0-9]{3}\.?[0-9]{3}\.?[0-9]{3}-?[0-9]{2}",
    "cnpj": r"[0-9A-Z]{3}/?[0-9A-Z]{4}-?[0-9]{2}",
    "pis": r"[0-9]{3}\.?[0-9]{5}\.?[0-9]{2}-?[0-9]",
    "email": r"@[A-Za-z0-9-]+\.",
    "telefone": r"[0-9]{4}(?:\s|-| )[0-9]{4}",
    "cartao": r"(?:[0-9][ .-]?){12}[0-9]",
    "senha": r"(?i)senha|passw|pwd",
}
