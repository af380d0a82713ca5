"""The discovery control at short lengths."""

import random
import string

import pytest

from twinsieve.llm import secrets

NOUNS = "user account service config manager handler request response session window button layout parser buffer stream index table column record policy".split()


def ordinary(draw, least):
    words, style = [], draw.randrange(4)
    while sum(map(len, words)) < least:
        words.append(draw.choice(NOUNS))
    return "_".join(words) if style == 0 else "".join(w.title() for w in words) if style == 1 else "/".join(words) + str(draw.randrange(99)) if style == 2 else "".join(words)


@pytest.mark.parametrize("letters, n, of", [(string.ascii_letters + string.digits, 20, 10), (string.ascii_letters + string.digits, 40, 100), (string.ascii_lowercase, 32, 10)])
def test_short_random_tokens_are_found(make, letters, n, of):
    draw = random.Random(n)
    rows = [(i, "the key " + "".join(draw.choice(letters) for _ in range(n)) + " is") for i in range(40)]
    rows += [(100 + i, f"see {ordinary(draw, n)} there") for i in range(40 * (of - 1))]
    rows += [(90000 + i, f"no {draw.randrange(10**29, 10**30)} is") for i in range(4000)]
    found = {r.doc_id for r in secrets.scan(make(rows)).collect() if any(s.kind == "random" for s in r.spans)}
    assert len([i for i in found if i < 100]) >= 30 and len([i for i in found if i >= 100]) <= 2
