from __future__ import annotations

import hashlib
import random
import string

import pytest

from skysift.llm import secrets

DRAW = random.Random(7)
ALNUM = string.ascii_letters + string.digits
JWT = "eyJ" + ".".join("".join(DRAW.choice(ALNUM) for _ in range(n)) for n in (150, 300, 86))
BODY = "\n".join("".join(DRAW.choice(ALNUM + "+/") for _ in range(64)) for _ in range(25))
KEY = f"-----BEGIN RSA PRIVATE KEY-----\n{BODY}\n-----END RSA PRIVATE KEY-----"


@pytest.mark.parametrize(("kind", "before", "value"), [
    ("assigned", "token=", JWT), ("assigned", "password = '", JWT.replace(".", "!")), ("jwt", "Bearer ", JWT), ("github", "use ", "ghp_" + JWT[:300].replace(".", "a")),
    ("private_key", "key:\n", KEY), ("private_key", 'secret="', KEY), ("private_key", "", "-----BEGIN PRIVATE KEY-----"),
])
def test_secrets_are_found_whole(kind, before, value):
    text = f"x {before}{value}' rest"
    assert [(k, text[v:e]) for k, _, v, e in secrets.find(text)] == [(kind, value)]


def test_unfinished_keys_end_at_their_first_line():
    text = f"-----BEGIN RSA PRIVATE KEY-----\nab\n{KEY}"
    assert [text[v:e] for _, _, v, e in secrets.find(text)] == ["-----BEGIN RSA PRIVATE KEY-----", KEY]


def test_long_secrets_are_hashed_whole_and_accepted(spark):
    texts = [f"the token={JWT} here", f"key\n{KEY}\nend", f"key\n{KEY.replace(BODY[:9], 'Zq4/Zq4/Z')}\nend"]
    out = secrets.scan(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    digests = {r.doc_id: (r.n_chars, r.value_sha256) for r in out}
    assert len(out) == 3 and all(r.is_secret for r in out)
    assert digests[0] == (len(JWT), hashlib.sha256(JWT.encode()).hexdigest())
    assert digests[1] == (len(KEY), hashlib.sha256(KEY.encode()).hexdigest()) and digests[1] != digests[2]
