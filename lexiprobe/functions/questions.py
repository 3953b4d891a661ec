"""Question detection, filtering and classification as column expressions.

Patterns run on the JVM with Unicode classes and with "\\n" as the only line terminator. Each set of
rules is an ordered list of (condition, label); the first that holds decides, none gives null. Rules
that an earlier rule of the same list always pre-empts are left out. Null text or language: null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

POLAR, CONTENT = "polar", "content"


def has(text: Column, *patterns: str, fold: bool = False) -> Column:
    """Whether any pattern is found; ``fold`` ignores case."""
    return text.rlike(("(?diU)" if fold else "(?dU)") + "|".join(f"(?:{p})" for p in patterns))


def opens(text: Column, pattern: str, fold: bool = False) -> Column:
    """Whether the pattern matches at the front."""
    return has(text, rf"\A(?:{pattern})", fold=fold)


def decide(*rules: tuple[Column, str | Column]) -> Column:
    out = None
    for condition, label in rules:
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return out


def _qa_en(text: Column) -> Column:
    low = F.lower(text)
    return decide((opens(low, P.QA_EN_WH), CONTENT), (opens(low, P.QA_EN_STARTER), POLAR), (has(low, P.QA_EN_WH), CONTENT))


def _qa_fi(text: Column) -> Column:
    low = F.lower(text)
    return decide((has(low, P.FI_WH), CONTENT), (has(low, P.FI_POLAR), POLAR))


def _qa_ko(text: Column) -> Column:
    asked = has(text, *P.QA_KO_OBVIOUS_WH)
    return F.when(F.length(text) >= 4, decide((has(text, *P.QA_KO_POLAR) & ~asked, POLAR), (has(text, P.KO_WH), CONTENT), (F.endswith(text, F.lit("?")) | has(text, P.QA_KO_ENDING), POLAR)))


def ja_wh(text: Column) -> Column:
    """Whether a question word ends at a word border (rare inside running Japanese)."""
    return has(text, *P.QA_JA_WH)


def _qa_ja(text: Column) -> Column:
    wh, strong = ja_wh(text), has(text, *P.QA_JA_STRONG)
    mark = F.endswith(text, F.lit("?")) | F.endswith(text, F.lit("？"))
    return decide(
        (~wh & (mark | strong | has(text, P.QA_JA_KA)), POLAR),
        (wh & strong & has(text, P.QA_JA_CLOSING) & ~has(text, P.QA_JA_ASKED), POLAR),
        (wh, CONTENT),
    )


def _ru(text: Column) -> Column:
    low = F.lower(text)
    return decide((has(low, P.RU_LI), POLAR), (has(low, P.RU_WH), CONTENT))


def _qa_ar(text: Column) -> Column:
    return decide((has(text, P.QA_AR_POLAR), POLAR), (has(text, P.AR_WH), CONTENT))


def _qa_id(text: Column) -> Column:
    low = F.lower(text)
    front = has(low, P.QA_ID_POLAR)
    return decide((front & has(low, P.QA_ID_YANG), CONTENT), (front, POLAR), (has(low, P.QA_ID_WH), CONTENT))


def _ud_en(text: Column) -> Column:
    polar = opens(text, P.UD_EN_STARTER, fold=True) | F.endswith(text, F.lit("?")) | has(text, P.UD_EN_CONJUNCTION, fold=True)
    return decide((has(text, P.UD_EN_WH, fold=True), CONTENT), (polar, POLAR))


def _ud_fi(text: Column) -> Column:
    return decide((has(text, P.FI_WH, fold=True), CONTENT), (has(text, P.FI_POLAR), POLAR))


def _ud_ko(text: Column) -> Column:
    return decide((has(text, P.KO_WH), CONTENT), (has(text, P.UD_KO_ENDING), POLAR))


def _ud_ja(text: Column) -> Column:
    return decide((has(text, P.UD_JA_WH), CONTENT), (has(text, P.UD_JA_KA, P.UD_JA_END), POLAR))


def _ud_ar(text: Column) -> Column:
    return decide((has(text, P.UD_AR_POLAR), POLAR), (has(text, P.UD_AR_WH) | F.endswith(text, F.lit("؟")), CONTENT))


def _ud_id(text: Column) -> Column:
    low = F.lower(text)
    return decide((has(low, *P.UD_ID_WH), CONTENT), (has(low, *P.UD_ID_POLAR, P.UD_ID_COPULA, P.UD_ID_MODAL, P.UD_ID_KAH), POLAR))


QA = {"en": _qa_en, "fi": _qa_fi, "ko": _qa_ko, "ja": _qa_ja, "ru": _ru, "ar": _qa_ar, "id": _qa_id}
UD = {"en": _ud_en, "fi": _ud_fi, "ko": _ud_ko, "ja": _ud_ja, "ru": _ru, "ar": _ud_ar, "id": _ud_id}


def _by_language(text: Column, language: Column, rules: dict) -> Column:
    return decide(*[(language == code, rule(text)) for code, rule in rules.items()])


def qa_class(text: Column, language: Column) -> Column:
    """Class of a corpus question by the qa rules of its language code; unknown codes give null."""
    return _by_language(text, language, QA)


def ud_class(text: Column, language: Column) -> Column:
    """Class of a treebank sentence by the ud rules of its language code; unknown codes give null."""
    return _by_language(text, language, UD)


def is_question(text: Column) -> Column:
    marks = "[" + "".join(P.QUESTION_MARKS) + "]"
    return has(text, marks.replace("?", r"\?", 1), "か。", P.JA_KA_END, "(?:" + "|".join(P.KO_ENDINGS) + r")\s*$")


def token_count(text: Column) -> Column:
    """Number of pieces between white space, of whatever kind."""
    return F.regexp_count(text, F.lit(r"(?U)[^\s\x1c-\x1f]+"))


def is_filtered(text: Column, min_tokens: int = 3, max_tokens: int = 40) -> Column:
    """Whether a question is rejected: length, doubled marks, unbalanced brackets, emoji."""
    n = token_count(text)
    count = lambda sign: F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))
    unbalanced = (count("(") != count(")")) | (count("[") != count("]")) | (count("{") != count("}"))
    emoji = "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in P.EMOJI) + "]"
    return (n < min_tokens) | (n > max_tokens) | has(text, P.BAD_MARKS) | unbalanced | has(text, emoji)


def ud_bucket(text: Column, language: Column, min_tokens: int = 3, max_tokens: int = 40) -> Column:
    """Where a treebank sentence goes: other, filtered, polar, content or unclassified."""
    return decide(
        (~is_question(text), "other"), (is_filtered(text, min_tokens, max_tokens), "filtered"), (text.isNotNull(), F.coalesce(ud_class(text, language), F.lit("unclassified")))
    )
