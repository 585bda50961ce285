"""Runs of card numbers: choices by local checks against choices made anew, and finds against planted values."""

from __future__ import annotations

import random

from docweave.llm.pii import _card_cuts, _Cuts, luhn_digit, pseudonyms

KEY = b"key of tests"


def _card(rng: random.Random, n: int = 16) -> str:
    digits = rng.choice("3456") + "".join(rng.choice("0123456789") for _ in range(n - 2))
    return digits + luhn_digit(digits)


def _chosen_anew(cuts, valid):
    used, out = set(), []
    for s, e in cuts:
        if valid[s, e] and not used & set(range(s, e)):
            used |= set(range(s, e))
            out.append((s, e))
    return sorted(out)


def test_local_checks_tell_whether_the_choice_stays():
    rng = random.Random(2)
    kept = 0
    for _ in range(400):
        run = " ".join("".join(rng.choice("0123456789") for _ in range(rng.choice([4, 4, 4, 5, 6, 13]))) for _ in range(rng.randint(3, 14)))
        cuts = list(_card_cuts(run))
        valid = {c: rng.random() < 0.4 for c in cuts}
        found = _Cuts(cuts, lambda s, e, valid=valid: valid[s, e])
        assert [(s, e) for s, e, _ in found.chosen] == _chosen_anew(cuts, valid)
        if not found.chosen:
            continue
        before = _chosen_anew(cuts, valid)
        start, end, rank = rng.choice(found.chosen)
        for s, e in cuts:
            if s < end and e > start:
                valid[s, e] = rng.random() < ((s, e) == (start, end)) * 0.9 + 0.1
        same = found.stays(start, end, rank)
        assert same == (_chosen_anew(cuts, valid) == before)
        kept += same
    assert kept > 50


def test_planted_values_are_found_and_nothing_else():
    rng = random.Random(4)
    for i in range(200):
        cards = [_card(rng) for _ in range(rng.randint(1, 6))]
        told = [c if rng.random() < 0.5 else " ".join(c[k : k + 4] for k in range(0, 16, 4)) for c in cards]
        text = " and ".join(["word", *told, f"order {i}x", "mail me.too@example.org"])
        new, counts = pseudonyms(text, KEY)
        assert {k: n for k, n in counts.items() if n} == {"card": len(cards), "email": 1}
        parts, news = text.split(" and "), new.split(" and ")
        assert len(parts) == len(news) and all((a != b) == (a in told or "@" in a) for a, b in zip(parts, news, strict=True))
        assert pseudonyms(new, KEY, undo=True)[0] == text


def test_checks_of_a_long_run_grow_with_its_length():
    def checks(n: int) -> int:
        run, made = "4111 1111 1111 1111 " * n, 0

        def valid(s: int, e: int) -> bool:
            nonlocal made
            made += 1
            return run[s:e] == "4111 1111 1111 1111"

        cuts = _Cuts(list(_card_cuts(run.strip())), valid)
        assert len(cuts.chosen) == n and all(cuts.stays(*c) for c in cuts.chosen)
        return made

    assert checks(800) <= 4.2 * checks(200)
