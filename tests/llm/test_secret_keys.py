"""Literals under names whose only tell-tale part is ``key``."""

import pytest

from lumenloom.llm import secret_scan


@pytest.mark.parametrize("name", ["signing_key", "ssh_key", "STRIPE_KEY", "masterKey", "deploy-key", "key"])
def test_random_literals_of_keys_are_found(name):
    text = f'{name} = "q7Zr-92LmX_v4TbN8sKd"'
    assert [text[a:b] for a, b, kind, *_ in secret_scan.spans(text) if kind == "lexed"] == ["q7Zr-92LmX_v4TbN8sKd"]


@pytest.mark.parametrize("text", ['signing_key = "identifier"', 'primary_key = "documents"', 'monkey = "q7Zr-92LmX_v4TbN8sKd"', 'keyboard = "q7Zr-92LmX_v4TbN8sKd"', 'signing_key = "changeme"'])
def test_plain_words_and_parts_of_words_are_not(text):
    assert secret_scan.spans(text) == []


def test_constants_of_keys_are_followed():
    text = 'A = "q7Zr-92LmX_v4TbN8sKd"\nsigning_key = A'
    assert [x[2] for x in secret_scan.spans(text)] == ["lexed"]


FOUND = [
    ('db_url = "postgres://u:Pa55w0rd9x@h/db"', "Pa55w0rd9x", "address_password"),
    ("amqp://guest:x9Kq2Lm8@broker:5672/v", "x9Kq2Lm8", "address_password"),
    ("PASSWORD: |\n  qX7pL2vN9s\nnext: 1", "qX7pL2vN9s", "PASSWORD"),
    ("conf:\n  - signing_key: >-\n      Zk3Vt8Qw1R\n    other: x", "Zk3Vt8Qw1R", "signing_key"),
    ('passphrase = "correct Horse battery 9staple"', "correct Horse battery 9staple", "passphrase"),
]


@pytest.mark.parametrize(("text", "value", "name"), FOUND)
def test_addresses_and_blocks(text, value, name):
    assert [(text[a:b], n) for a, b, n, _ in secret_scan.lexed_spans(text)] == [(value, name)]


@pytest.mark.parametrize("text", ["the key: Monday10am works for us", 'auth = "the quick brown fox"', "see http://host:8080/path", "list: |\n  plain words here", "We said the token: Friday2pm is fine, thanks"])
def test_prose_is_no_secret(text):
    assert secret_scan.lexed_spans(text) == []


def test_running_text_of_the_corpus_raises_no_alarm(spark, sf_dir):
    """Whole documents whose assignments are taken out hold nothing that only the lexer would find."""
    import re

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()
    texts = [re.sub(r"\S*[=:]\S*\s*\S*", " ", r.text or "") for r in rows]
    assert sum(bool(secret_scan.lexed_spans(t)) for t in texts) == 0
