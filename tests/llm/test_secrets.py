import hashlib
import random
import re

from docquarry.llm.secrets import automaton, check_digits, find, find_secrets, op7_secret_scan
from tests.llm.data import odd, store, table, with_extra

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_base_against_plain_search():
    random.seed(8)
    keywords = automaton()
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", " = ", '"', "'", " ", "AKIA", "AKIA" + "X" * 12, "abcdef0123456789" * 2, "x1", "secretsecret", "é", "K", "ſ", "İ", "\n", "ABCDEFGH", "0123456", "==", "-._/"]
    for _ in range(4000):
        text = "".join(random.choice(parts) for _ in range(random.randrange(0, 16)))
        got = [s for s in find(text, keywords) if s[0] in ("assign", "access", "hex")]
        assert got == base(text), repr(text)


def test_check_sums():
    keywords = automaton()
    body = "0A1b2C3d4E5f6G7h8I9j0K1l2M3n4O"
    good = body + check_digits(body)
    bad = body + check_digits(body[::-1])
    text = f"é ghp_{good} npm_{good} ghp_{bad} gho_{good}x ghs_{good}"
    assert [s[0] for s in find(text, keywords)] == ["github", "npm", "github"]
    assert [text[a:b] for _, a, b in find(text, keywords)] == [f"ghp_{good}", f"npm_{good}", f"ghs_{good}"]
    assert check_digits("") == "000000" and len(check_digits(body)) == 6


def check(docs, found):
    want = []
    for doc_id, text in docs:
        spans = base(text or "")
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        want.append((doc_id, *[sum(k == x for k, _, _ in spans) for x in ("assign", "access", "hex")], digest))
    key = lambda r: (r[0] is not None, r[0] or 0, r[4])
    assert sorted([tuple(r)[:5] for r in found], key=key) == sorted(want, key=key)


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    found = op7_secret_scan(spark, sf).collect()
    check(docs, found)


def test_odd_rows(spark, tmp_path):
    df = odd(spark)
    check(df.select("doc_id", "text").collect(), op7_secret_scan(spark, store(df, tmp_path / "a")).collect())
    assert op7_secret_scan(spark, store(table(spark, []), tmp_path / "b")).count() == 0
    extra = with_extra(df)
    assert find_secrets(extra).columns == [*extra.columns, "_spans"]
