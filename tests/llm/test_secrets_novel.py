"""Secrets that novelty finds whatever their characters, and with the sensitive word on either side or another line."""

from __future__ import annotations

import random
import string

import pytest

from lodestone.llm import secrets_scan

KEY = string.ascii_letters + string.digits + "+/"


def drawn(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


def novel(text):
    return [text[a:b] for a, k, b in secrets_scan.spans_of(text)[1] if k == "novel"]


@pytest.mark.parametrize("alphabet", [KEY, string.ascii_letters, string.digits, "0123456789ABCDEF"])
@pytest.mark.parametrize("n", [16, 20, 24, 32, 40, 64])
def test_keys_of_any_characters(alphabet, n):
    rng = random.Random(n)
    for _ in range(40):
        key = drawn(rng, alphabet, n)
        text = f"the private key is {key} for now"
        # 24 and more digits are the base kind hex
        assert [text[a:b] for a, _, b in secrets_scan.spans_of(text)[1]] == [key]


def test_context_on_both_sides_and_other_lines():
    rng = random.Random(1)
    key = drawn(rng, KEY, 32)
    assert novel(f"{key} is the signature") == [key]
    assert novel(f"credential:\n  {key}\n") == [key]
    assert novel("key " + "of no one " * 30 + key) == []


def test_key_block():
    rng = random.Random(3)
    lines = [drawn(rng, KEY, 64) for _ in range(26)]
    body = "\n".join(lines)
    text = f"-----BEGIN PRIVATE KEY-----\n{body}\n-----END PRIVATE KEY-----\n"
    assert novel(text) == lines and not any(x in secrets_scan.redacted(text) for x in lines)


def test_words_and_repeats_stay():
    assert novel("the key is 00000000000000000000 or xxxxxxxxxxxxxxxxxxxxxxxx, user_name_session_id, configuration_manager") == []


def test_keys_that_a_base_span_covers_in_part():
    rng = random.Random(5)
    head, tail = drawn(rng, string.ascii_uppercase, 20), drawn(rng, string.ascii_uppercase, 20)
    for key in (f"{head}{drawn(rng, "0123456789abcdef", 24)}{tail}", f"{head.lower()}AKIA{drawn(rng, string.ascii_uppercase, 16)}{tail.lower()}"):
        text = f"the private key is {key} for now"
        assert novel(text) == [key]
        assert secrets_scan.redacted(text) == "the private key is [SECRET] for now"
    assert novel("the private key is 0123abcd4567ef890123abcd") == []
