import random
import re

import pytest
from pyspark.sql import functions as F

from sievefold.functions.fold import display_text, fold_text
from sievefold.functions.presets import PRESETS
from sievefold.functions.validators import VALIDATORS
from sievefold.operators import matching as m


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [("  Ação   SALÁRIO\tJoão ", "acao salario joao"), ("İstanbul Ærø Ñandú", "istanbul ærø nandu"), ("한국어 각", "한국어 각"), ("straße", "straße"), (None, ""), ("", "")],
)
def test_fold(spark, text, want):
    assert one(spark, text, fold_text(F.col("text"))) == want


def test_fold_composes(spark):
    assert one(spark, "café x̧", fold_text(F.col("text"), compose=True)) == "cafe x̧"
    assert one(spark, "a\x00b �c", display_text(F.col("text"))) == "a b c"


def counts(spark, text, terms):
    docs = spark.createDataFrame([(1, text)], "id long, text string")
    return {r.term_id: r["count"] for r in m.text_hits(docs, terms).collect()}


CASES = [
    ("Folha: SALÁRIO de março e salário de abril", [("t", "salario", False)], {"t": 2}),
    ("joao  da\r\nsilva", [("t", "João da Silva", False)], {"t": 1}),
    ("banana e mariana", [("t", "ana", True)], {}),
    ("relatorio_ana.xlsx - Ana, RH", [("t", "ana", True)], {"t": 2}),
    ("ushers", [("she", "she", False), ("he", "he", False), ("his", "his", False), ("hers", "hers", False)], {"she": 1, "he": 1, "hers": 1}),
    ("aaaa", [("t", "aa", False)], {"t": 3}),
    ("c++ c++x", [("t", "C++", True)], {"t": 2}),
]


@pytest.mark.parametrize(("text", "terms", "want"), CASES)
def test_terms(spark, text, terms, want):
    assert counts(spark, text, terms) == want
    many = terms + [(f"x{k}", f"no such term {k}", False) for k in range(m.FEW_TERMS + 1)]
    assert counts(spark, text, many) == want


def test_two_thousand_terms(spark):
    terms = [(f"codigo-{k}", f"codigo-{k}", True) for k in range(2000)]
    assert counts(spark, "codigo-15, CODIGO-1999, codigo-150x", terms) == {"codigo-15": 1, "codigo-1999": 1}


@pytest.mark.parametrize(
    ("kind", "value", "valid"),
    [
        ("cpf", "529.982.247-25", True), ("cpf", "000.000.000-00", False), ("cpf", "529.982.247-24", False), ("cpf", None, False), ("cnpj", "11.222.333/0001-81", True), ("cnpj", "11222333000182", False), ("cnpj", "12.ABC.345/01DE-35", True),
        ("cnpj", "12.abc.345/01de-35", False), ("cartao", "4111 1111 1111 1111", True), ("cartao", "4111 1111 1111 1112", False), ("pis", "17033259504", True), ("pis", "17033259505", False), ("cartao", "", False),
    ],
)
def test_validators(spark, kind, value, valid):
    assert one(spark, value, VALIDATORS[kind](F.col("text"))) is valid


def test_presets(spark):
    text = "CPF 529.982.247-25 e 111.111.111-11\nCNPJ 11.222.333/0001-81 e 12.ABC.345/01DE-35\nPIS 170.33259.50-4\nana@empresa.com.br\n(11) 98765-4321\n4111 1111 1111 1111\nsenha: abc123"
    docs = spark.createDataFrame([(1, text)], "id long, text string")
    got = {r.term_id: r["count"] for r in m.preset_hits(docs).collect()}
    assert got == {"cpf": 1, "cnpj": 2, "pis": 1, "email": 1, "telefone": 1, "cartao": 1, "senha": 1}


def test_hit_record(spark):
    docs = spark.createDataFrame([(1, " ".join(f"a{k}@x.org" for k in range(15)))], "id long, text string")
    hit = m.preset_hits(docs, ["email"]).first()
    assert (hit["count"], hit["values"], hit["truncated"]) == (15, [f"a{k}@x.org" for k in range(10)], False)


def test_samples(spark):
    rng = random.Random(1)
    for _ in range(10):
        words = [rng.choice(["ana@x.org", "texto", "linha\n", "çã"]) for _ in range(80)]
        text = " ".join(words)
        got = one(spark, text, m.first_samples(F.col("text"), PRESETS["email"][0]))
        want = [(x.group(), text.count("\n", 0, x.start()) + 1) for x in list(re.finditer(r"ana@x\.org", text))[:3]]
        assert [(s.match, s.line) for s in got] == want
        for s, x in zip(got, re.finditer(r"ana@x\.org", text), strict=False):
            left = re.sub(r"\s+", " ", text[max(0, x.start() - 60) : x.start()]).lstrip()
            assert s.before == ("…" if x.start() > 60 else "") + left


@pytest.mark.parametrize(("value", "kind", "want"), [("a*", "regex", "matches-empty"), ("(", "regex", "pattern"), (" ", "text", "empty"), ("x", "text", None), ("x", "other", "type")])
def test_term_errors(value, kind, want):
    assert m.term_error(value, kind) == want


def test_many_distinct_terms(spark):
    """No term is cut off, however many lists together hold."""
    from sievefold.operators.matching import MAX_TERMS, distinct_terms

    terms = spark.range(MAX_TERMS + 5).selectExpr("id as seq", "'text' as type", "concat('t', id) as value", "false as wholeWord", "cast(null as string) as validator")
    assert distinct_terms(terms).count() == MAX_TERMS + 5


def test_too_long_a_list(spark, sf, monkeypatch):
    import pytest

    from sievefold.plans import matching as plans

    monkeypatch.setattr(plans.m, "MAX_TERMS", 3)
    with pytest.raises(ValueError):
        plans.m2_many_terms(spark, sf)


def test_card_candidates_of_large_keys(spark, tmp_path):
    """The products of large keys, which a long can't hold, are exact."""
    from sievefold.plans import catalog, matching  # noqa: F401

    keys = [*range(3_000_000, 3_000_400), 36_000_000, 9_000_000_000_000_000_000]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    found = {(x.id, x.v) for x in catalog.QUERIES["v3_card"](spark, str(tmp_path)).collect()}
    numbers = {k: str(k * 4435567890123 % 10**16).rjust(16, "0") for k in keys}
    luhn = lambda d: sum((int(c) * 2 - 9 * (c > "4") if i % 2 else int(c)) for i, c in enumerate(reversed(d))) % 10 == 0
    assert found == {(k, v) for k, v in numbers.items() if v[0] in "3456" and len(set(v)) > 1 and luhn(v)}
