"""Where novel strings are looked for, and their copies."""

from __future__ import annotations

import random
import string

import pytest

from lexiforge.llm.secret_scan import scan

KEY = "q8Zt4VnX0pLr7Ks2WyB9"
LETTERS = "qZtVnXpLrKsWyBgHjDmC"


def novel(text):
    return [(s["start"], s["string"]) for s in scan(text)["found"] if s["kind"] == "novel"]


@pytest.mark.parametrize(
    "text",
    [
        f"credential:\n  {KEY}\nend",
        f"{KEY} is the credential of this host",
        f"use {KEY}\nas the private key",
        f"Authorization: Bearer\n\tx\n\ty\n\t{KEY}\nnext",
        f"the credential {'of this long line ' * 10}is {KEY} here",
    ],
)
def test_lines_around_a_sensitive_word(text):
    assert novel(text) == [(text.index(KEY), KEY)]


def test_pem_blocks():
    draw = random.Random(7)
    lines = ["".join(draw.choices(string.ascii_letters + string.digits + "+/", k=64)) for _ in range(12)]
    text = "\n".join(["before", "-----BEGIN RSA PRIVATE KEY-----", *lines, "-----END RSA PRIVATE KEY-----", "after"])
    assert [s for _, s in novel(text)] == lines


def test_strings_without_digits():
    assert novel(f"credential -> {LETTERS}.") == [(14, LETTERS)]
    known = b"the quick brown fox jumps thunder struck ness un characteristic ally "
    for word in ("getUserAuthenticationTokenProvider", "TheQuickBrownFoxJumps", "thunderstruckness", "uncharacteristically"):
        assert scan(f"see the credential in {word} first", known)["spans"] == ""


def test_every_copy_is_reported():
    text = f"credential -> {KEY}\ncredential -> {KEY}\n" + "plain line\n" * 50 + f"again {KEY}"
    assert novel(text) == [(i, KEY) for i in range(len(text)) if text.startswith(KEY, i)]
    assert len(novel(text)) == 3


def test_far_from_sensitive_words_nothing_is_novel():
    assert novel("the private key\n" + "plain line\n" * 5 + KEY) == []
