"""Secret scans against the base rules spelled out, and the lexer on small sources."""

import hashlib
import re
import time

import pytest

from lakeops.llm import queries, secrets

from tests.llm.fixtures import edge_docs, edge_rows, no_docs

LITERALS = [
    ('{"clientCredential": "Zx81kk22lm"}', ["Zx81kk22lm"]), ("<passphrase>q8e7r6t5y4</passphrase>", ["q8e7r6t5y4"]),
    ("export DB_PWD=s3cr3tValue9", ["s3cr3tValue9"]), ('a = "hunter2-xK9"\ndb_pwd = a', ["hunter2-xK9"]),
    ('k = "abc123" + "def456"\napp_pwd = k', ["abc123", "def456"]), ('x = "s9d8f7g6"\npwd = "${x}"', ["s9d8f7g6"]),
    ("pwd: changeme", []), ("password_length = 12345678", []), ('colour = "s9d8f7g6h5"', []), ("The time: 12:30 and a = b", []),
    ('cfg["signing_key"] = \'aa11bb22cc\'', ["aa11bb22cc"]),
    # declarations with types
    ('db_pwd: str = "Zx81kk22lm"', ["Zx81kk22lm"]), ('const accessKey: string = "Zx81kk22lm";', ["Zx81kk22lm"]), ('val authCred: Option<String> = "Zx81kk22lm"', []),
    ('val dbCredential: String = "Zx81kk22lm"', ["Zx81kk22lm"]), ('var pwd string = "Zx81kk22lm"', ["Zx81kk22lm"]), ('db_pwd: Optional[str] = "Zx81kk22lm"', ["Zx81kk22lm"]),
    ('let pwd: &\'static str = "Zx81kk22lm";', ["Zx81kk22lm"]), ('char pwd[] = "Zx81kk22lm";', ["Zx81kk22lm"]), ('private static final String DB_PWD = "Zx81kk22lm";', ["Zx81kk22lm"]),
    ('class A:\n    db_pwd: str\n    access_key: SecretStr\n', []), ('$pwd = "Zx81kk22lm";\n$db_pwd = $pwd;', ["Zx81kk22lm"]),
    # arguments of calls
    ('db_pwd = os.environ.get("X", "Zx81kk22lm")', ["Zx81kk22lm"]), ('db_pwd = os.environ["DB_PWD_PROD"]', []), ('db_pwd = getenv("DB_PWD_PROD")', []),
    ('let pwd = String::from("Zx81kk22lm");', ["Zx81kk22lm"]), ('let pwd = "Zx81kk22lm".to_string();', ["Zx81kk22lm"]), ('define("DB_PWD", "Zx81kk22lm");', ["Zx81kk22lm"]),
    ('pwd = new Secret("Zx81kk22lm")', ["Zx81kk22lm"]), ('connect(user="someone11x", pwd="Zx81kk22lm")', ["Zx81kk22lm"]), ('credential = connect(user="someone11x", host="h1.example9")', []),
    ('k = env("K_NAME", "Zx81kk22lm")\ndb_pwd = k', ["Zx81kk22lm"]), ('db_pwd = get_password(user.name, account2)', []), ('pwd = settings.database.pwd2', []),
    ('db_pwd = cfg["pwd"] or "Zx81kk22lm"', ["Zx81kk22lm"]), ('pwd = ok ? "Zx81kk22lm" : "Qw92jj33po"', ["Zx81kk22lm", "Qw92jj33po"]),
    # neighbours, sums, lists, values on the next line
    ('app_pwd = ("abc123"\n  "def456")', ["abc123", "def456"]), ('app_pwd = "abc123" "def456"', ["abc123", "def456"]), ('app_pwd =\n    "Zx81kk22lm"', ["Zx81kk22lm"]),
    ('app_pwd = "abc123"\n    + "def456";', ["abc123", "def456"]), ('passwords = ["Zx81kk22lm", "Qw92jj33po"]', ["Zx81kk22lm", "Qw92jj33po"]),
    ('p = "abc123"\np += "def456"\npwd = p', ["abc123", "def456"]), ('a = db_pwd = "Zx81kk22lm"', ["Zx81kk22lm"]), ('db_pwd = a = "Zx81kk22lm"', ["Zx81kk22lm"]),
    ('x = "Zx81kk22lm"\nx = compute()\npwd = x', []), ('pwd = f"{user}:{word}:{host}"', []),
    # configuration
    ("pwd: Zx81kk22lm\nuser: me", ["Zx81kk22lm"]), ("- pwd: correcthorse", ["correcthorse"]), ("DB_PWD=correcthorse", ["correcthorse"]), ("run --db-pwd=Zx81-kk22lm now", ["Zx81-kk22lm"]),
    ("Server=a1;Pwd=Zx81/kk22lm;x", ["Zx81/kk22lm"]), ("db_pwd = correcthorse9  # old", ["correcthorse9"]), ("db_pwd =\nuser = someone11x", []),
    ("private_key: |\n  line1AAA\n  line2BBB\nuser: me", ["line1AAA", "line2BBB"]), ("a:\n  signing_key: >-\n    Zx81kk22lm\n  b: 1", ["Zx81kk22lm"]),
    ('<entry key="db_pwd">Zx81kk22lm</entry>', ["Zx81kk22lm"]), ('<add key="db_pwd" value="Zx81kk22lm"/>', ["Zx81kk22lm"]), ('<user pwd="Zx81kk22lm" id="a"/>', ["Zx81kk22lm"]),
    ('{"pwd": "Zx81kk22lm", "user": "someone11x"}', ["Zx81kk22lm"]), ('{"credentials": {"user": "someone11x", "host": "h1.example9"}}', []),
    # prose
    ("The passphrase: patience and courage win.", []), ("We say passphrase = something else, or so.", []), ("credential: see (below), it was \"quoted words\"", []),
]


def slow_base(text):
    """The base rules as they are stated, without any shortening."""
    spans = []
    rule = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    spans += [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in re.finditer(rule, text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [s for *_, s in sorted(spans)]


@pytest.mark.parametrize("text, values", LITERALS)
def test_lexer(text, values):
    base, every = secrets.find_secrets(text)
    assert [text[s.value:s.end] for s in every if s.kind in ("literal", "flow")] == values
    clean = secrets.redacted(text, every)
    assert not any(v in clean for v in values) and (clean == text or every)


@pytest.mark.parametrize("piece", ["a=(", "pwd = [", "x: {", "k = \"\"\" ", "a = b = ", "<a b ", "pwd: |\n ", "f(\"pwd\", ", "v: T | ", "'", "/*"])
def test_time_grows_with_the_text(piece):
    began = time.process_time()
    secrets.find_secrets(piece * (400_000 // len(piece)))
    assert time.process_time() - began < 20


@pytest.mark.parametrize("text", [
    "token=" + "ab" * 20, "PASSWORD : 'abcdef' api_key=xyz", "password = token: \"abcdef1\"", "AKIAAKIA" + "Z9" * 8 + " AKIA1234", "ToKen = short", "ſecret=abcdefg toKen=abcdefg",
    "0" * 23 + " " + "f" * 24 + "G", "é" * 7 + " secret: abc/def+=", "", "token=a.b-c_d=" * 3])
def test_base(text):
    base, every = secrets.find_secrets(text)
    assert [f"{s.kind}:{s.start}:{s.end}" for s in base] == slow_base(text)
    assert set(base) <= set(every)


def expect(i, text):
    base = slow_base(text or "")
    counts = [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]
    return (i, *counts, hashlib.sha256(",".join(base).encode()).hexdigest())


def test_scan(spark, sf):
    got = sorted(tuple(r)[:5] for r in queries.op2_secret_scan(spark, sf).collect())
    assert got == sorted(expect(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    key = lambda t: (t[0] is not None, t)
    assert sorted((tuple(r)[:5] for r in secrets.scan(edge_docs(spark)).collect()), key=key) == sorted((expect(i, t) for i, t, *_ in edge_rows()), key=key)
    assert secrets.scan(no_docs(spark)).collect() == []


def test_redact(spark):
    rows = [(1, "token = 'abcdefgh12' end", "en", "a", 24), (2, None, None, None, None), (3, "clean", "en", "a", 5), (4, "api_key=0123456789", "en", "a", None)]
    docs = edge_docs(spark, rows)
    out = secrets.redact(docs)
    assert out.schema == docs.schema
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: ("token = '[SECRET]' end", 22), 2: (None, None), 3: ("clean", 5), 4: ("api_key=[SECRET]", None)}
    assert secrets.redact(no_docs(spark)).collect() == []
