"""Disguised identifiers that cheap tests of the whole text used to hide."""

import random

import pytest

from tickloom.llm import pii


def spans(text):
    return pii.write(pii.find_disguised(text, pii.find(text)))


@pytest.mark.parametrize("gap", [" ", "\t", "\n"])
@pytest.mark.parametrize(
    "text",
    ["+49 30 123 four 5678", "+49 30 seven seven seven 4567", "plus 49 30 1234567", "4111 1111 1111 one one one one", "jane [ at ] example.com", "jane < at > example.com", "jane { @ } example.com", "jane at example.com", "jane [at] example [ dot ] com"],
)
def test_one_sign_is_enough(text, gap):
    """A text with one kind of sign, whatever blanks it has, is read as if the text held signs of every kind."""
    text = text.replace(" at ", f"{gap}at{gap}")
    assert spans(text) and spans(text) == spans(text + " -- zero or nine [.] ѕ")


@pytest.mark.parametrize(
    "text, found",
    [
        ("jane at example dot ch", "email:0:22"), ("anna at firma punto it", "email:0:22"), ("jane at example dot nl", "email:0:22"), ("jane at mail dot example (dot) museum", "email:0:37"), ("192 dot 168 dot one dot one", "ip:0:27"), ("ten point 10 dot zero [.] 0 dot nine", "ip:10:36"),
        ("look at the dot and go", ""), ("aim at each dot on it", ""), ("we met at noon.Then left", ""), ("one dot here", ""),
    ],
)
def test_spelled_dots(text, found):
    assert spans(text) == found


@pytest.mark.parametrize(
    "text, found",
    [("plus nine nine nine nine nine nine nine nine nine nine", "phone:0:54"), ("call plus; four: nine: one: two three four five six seven eight", "phone:5:63"), ("juan arroba ejemplo punto es", "email:0:28"), ("one nine two dot one six eight dot zero dot one", "ip:0:47"), ("two arroba of salt", ""), ("one two dot", "")],
)
def test_signs_that_once_hid_them(text, found):
    assert spans(text) == found


@pytest.mark.parametrize(
    "text",
    [
        "find it at www.example.com", "we arrived at example.com", "Visit us at shop.example.de today", "The meeting at noon dot com was long", "We stayed at home dot net of fees", "look at the dot com bubble", "more at example.org/news",
        "He laughed at two dot com jokes", "names like look_at_me and dot_dot_com stay", "meet me at example.io", "oh dear, 5 of them", "jane at www.example.com",
    ],
)
def test_prose_is_left_alone(text):
    assert spans(text) == ""


@pytest.mark.parametrize(
    "text, found",
    [
        ("jane (a) example.com", "email:0:20"), ("jane [ät] example.com", "email:0:21"), ("jane_at_example_dot_com", "email:0:23"), ("jane_doe_at_mail_dot_example_dot_org now", "email:0:36"), ("jean arobase exemple punto fr", "email:0:29"), ("max klammeraffe beispiel punkt de", "email:0:33"),
        ("j.meeting at example.com", "email:0:24"), ("meeting [at] example.com", "email:0:24"), ("plus four four oh two oh seven one two three four five", "phone:0:54"),
    ],
)
def test_further_disguises(text, found):
    assert spans(text) == found


def test_random_disguises():
    """Plain identifiers, disguised sign by sign, are found where they stand in a text around them."""
    rng = random.Random(4)
    words = {str(i): w for i, w in enumerate("zero one two three four five six seven eight nine".split())}
    alike = {"a": "\u0430", "e": "\u0435", "o": "\u043e", "c": "\u0441", "1": "\uff11", "2": "\u0662"}
    for _ in range(3000):
        kind = rng.choice(["email", "ip", "phone"])
        if kind == "email":
            name = f"{rng.choice(['jane', 'a.cook', 'x_1'])}"
            made = name + rng.choice([" at ", " [at] ", " (at) ", "@", " { at } "]) + "mail" + rng.choice([" dot ", " [dot] ", ".", " ( . ) "]) + "example" + rng.choice([" dot ", ".", "[dot]"]) + rng.choice(["com", "org"])
        elif kind == "ip":
            parts = [str(rng.randrange(256)) for _ in range(4)]
            made = rng.choice([" dot ", ".", " [.] ", "(dot)"]).join(parts)
            if rng.random() < 0.3:
                made = " dot ".join(" ".join(words[d] for d in p) for p in parts)
        else:
            digits = [str(rng.randrange(10)) for _ in range(rng.randrange(10, 16))]
            made = rng.choice(["plus ", "+"])
            spell = rng.random() < 0.5
            made += (" " if spell else rng.choice(["", " ", "-"])).join(words[d] if spell else d for d in digits)
        made = "".join(alike[c] if c in alike and rng.random() < 0.2 and not any(w in made for w in words.values()) and "at" not in made and "dot" not in made and "plus" not in made else c for c in made)
        lead = rng.choice(["", "see: ", "Write to ", "x\n"])
        text = lead + made + rng.choice(["", " - thanks", "\nbye"])
        base = pii.find(text)
        got = pii.write(sorted(base + pii.find_disguised(text, base)))
        assert f"{kind}:{len(lead)}:{len(lead) + len(made)}" in got.split(","), (text, got)
