"""Operators that judge each document alone: licenses, secrets, repetition."""

import hashlib
import re
import time

import pytest
from llm_cases import LOWER, words
from hypothesis import given, settings
from hypothesis import strategies as st

from pipelens.llm import licenses, repetition, secrets


def rows_of(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


# --- licenses -------------------------------------------------------------

PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}


def plain_licenses(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = [(i, label) for phrase, label in PHRASES.items() for i in range(len(found))
              if tuple(found[i:i + len(phrase)]) == phrase]
    at = [i for i, _ in places]
    return (len(found), len(at), min(at, default=None), max(at, default=None),
            ",".join(sorted({label for _, label in places})))


def check_licenses(docs):
    got = rows_of(licenses.license_scan(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    want = {(r.doc_id, r.text or "") for r in docs.collect()}
    assert got == sorted(((i, *plain_licenses(t)) for i, t in want), key=repr)


def test_license_base_places(documents, awkward, no_documents):
    check_licenses(documents)
    check_licenses(awkward)
    check_licenses(no_documents)


def test_license_templates_survive_edits(spark):
    texts = ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
             "x y Permission is hereby now granted, free of charge, to any person who is obtaining a copy of this software",
             "Permission is needed to obtain a copy", "This is licensed under the Apache License, Version 2.0!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    assert [got[i].labels for i in range(4)] == ["mit", "mit", "", "apache-2.0"]
    assert got[0].score == 1.0 and 0.75 <= got[1].score < 1.0 and got[2].score == 0.0
    assert got[0].base_labels == "" and got[0].n_base == 0


def test_license_scan_is_native(documents):
    plan = licenses.license_scan(documents)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- secrets --------------------------------------------------------------

def plain_base(text):
    """The three patterns as the contract words them, kinds one by one."""
    rules = [("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
             ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32)]
    found = []
    for kind, (name, pattern, group, least) in enumerate(rules):
        found += [(m.start(), kind, m.end(), name) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    found.sort()
    line = ",".join(f"{n}:{a}:{b}" for a, _, b, n in found)
    return [sum(k == i for _, k, _, _ in found) for i in range(3)], hashlib.sha256(line.encode()).hexdigest(), line


def check_secrets(docs):
    got = rows_of(secrets.secret_scan(docs), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    want = [(r.doc_id, *plain_base(r.text)[0], plain_base(r.text)[1]) for r in docs.collect()]
    assert got == sorted(want, key=repr)


def test_secret_base_spans(documents, awkward, no_documents):
    check_secrets(documents)
    check_secrets(awkward)
    check_secrets(no_documents)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "Token", "api_key", "APIKEY", "=", ": ", '"', "'", " ", "AKIA", "AKIAB",
                                 "0123456789abcdef", "ABCDEFGHIJKL", "deadbeef", "é", "ſecret", "x" * 9, "\n"]),
                max_size=14).map("".join))
def test_secret_base_spans_of_any_text(text):
    got = secrets.write(secrets.base_spans(text))
    assert got == plain_base(text)[2]


def test_secret_lexer_follows_constants():
    text = 'k = "Zx81-qqPl0-77aWe"\ncolor = "Zx81-qqPl0-77aWf"\ndb_credentials = k\nclientSecret: hunter2hunter2Z'
    found = {text[s.start:s.end] for s in secrets.literal_spans(text)}
    assert found == {"Zx81-qqPl0-77aWe", "hunter2hunter2Z"}
    for clean in ("password = none", "token: ${TOKEN_FROM_ENV}", 'secret_santa = "a b c d e f"', "color = 99887766aabb"):
        assert secrets.literal_spans(clean) == []
    assert secrets.literal_spans('<privateKey>q8Zk31LmPw02</privateKey>')[0].kind == 3


def test_secret_every_listed_name_can_pass():
    """A strong literal under any listed name is found, words under it are not."""
    for name, weight in secrets.NAME_WEIGHT.items():
        for value in ("f8Kd93mQ2xLp", "9f86d081884c7d659a2f", "Zx81-qqPl0-77aWe"):
            text = f'my_{name} = "{value}"'
            assert [text[s.start:s.end] for s in secrets.literal_spans(text)] == [value], (name, value)
        if weight < 0.8:
            for value in ("customer_identifier", "/etc/ssl/certs/server.pem", "2024-01-01T00:00:00Z", "getUserPreferences2",
                          "user_profile_v2_settings", "aaaaaaaaaaaaaaaaaaa1a1a1a1a1a1a"):
                assert secrets.literal_spans(f'my_{name}: "{value}"') == [], (name, value)


def test_secret_one_class_literals_and_passphrases():
    for text in ('db_pwd = "abcdefghijklmnop"', 'db_pwd = "8391047562839104"', 'credentials: "qmwnebrvtcyxuzia"',
                 'passphrase = "correct horse battery staple"', 'authorization: "Bearer f8Kd93mQ2xLp7Zt1"'):
        span, = secrets.literal_spans(text)
        assert text[span.start:span.end] == re.search('"(.*)"', text)[1] and span.score <= 1
    for text in ('db_pwd = "username"', 'pwd_hint: "please enter your new one here"', 'session: "correct horse battery staple"',
                 'db_pwd = "aaaaaaaaaaaaaaaaaaaaaaaa"'):
        assert secrets.literal_spans(text) == []


def test_redaction_leaves_nothing_to_find():
    text = 'db_pwd = "Zx81-qqPl0-77aWe"\nencryption_key: f8Kd93mQ2xLp7Zt1'
    clean = secrets.redact(text, secrets.scan_text(text))
    assert clean == 'db_pwd = "[SECRET]"\nencryption_key: [SECRET]' and secrets.scan_text(clean) == []


def test_redaction_cuts_overlaps_once(spark):
    text = 'a token = "0641917ea4e9feb9cda83477b57ac2654884f485" b'
    assert secrets.redact(text, secrets.scan_text(text)) == 'a [SECRET]" b'
    docs = spark.createDataFrame([(1, text, None), (2, None, 3), (3, "clean", 4)], "doc_id long, text string, copy int")
    got = secrets.redact_documents(docs)
    assert got.columns == docs.columns
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == [(1, 'a [SECRET]" b', None), (2, None, 3), (3, "clean", 4)]

def test_secret_forms_of_assignment():
    """Subscripts, types, constants set further down; calls and paths are none."""
    value = "q7Rw2ZkP9xLmT4vB"
    for text in (f'config["db_pwd"] = "{value}"', f'pwd: str = "{value}"', f'const dbPwd string = "{value}"',
                 f'note: pwd = "{value}"', f'db_pwd = RAW\nRAW = "{value}"', f'db_pwd = FIRST\nFIRST = OTHER\nOTHER = "{value}"',
                 f'a = b\nb = a\npwd = "{value}"'):
        spans = secrets.literal_spans(text)
        assert [text[s.start:s.end] for s in spans] == [value], text
    for text in ('pwd = os.environ.get("PWD")', 'key = "assets/img2021/a1b2c3/file99x8.png"', "pwd = pwd", "pwd == other_name_1"):
        assert secrets.literal_spans(text) == [], text


V, W = "q7Rw2ZkP9xLmT4vB", "Zx81Kq0PlU77aWeD"


@pytest.mark.parametrize("text", [
    # Python
    f'config["db"]["password_hash"] = "{V}"', f'pwd: str = "{V}"', f'pwd: Optional[str] = r"{V}"', f'pwd = """{V}"""',
    f"pwd = \'\'\'\n{V}\n\'\'\'", f'pwd = (\n    "{V}"\n)', f'pwd = \\\n    "{V}"', f'self.db_pwd = b"{V}"',
    f'connect(user="me", pwd="{V}")', f'pwd = os.environ.get("DB_PWD", "{V}")', f'pwd = SecretStr("{V}")',
    f'pwds = ["x", "{V}"]', f'# pwd = "{V}"', f'settings = dict(raw="{V}")\ndb_pwd = settings["raw"]',
    # JavaScript, Java, Go, PHP, Rust
    f'const dbPwd string = "{V}"', f'dbPwd := "{V}"', f'const dbPwd = `{V}`;', f'private static final String PWD = "{V}";',
    f'let o = {{ pwd: "{V}" }}', f"$o = ['pwd' => '{V}'];", f'let pwd: &str = "{V}";', f'x.pwd = new Secret("{V}")',
    # shell
    f"export DB_PWD={V}", f"RAW={V}\nexport DB_PWD=$RAW", f'RAW={V}\nDB_PWD="${{RAW}}"', f"DB_PWD=$RAW\nRAW={V}",
    # JSON, YAML
    f'{{"a": 1, "db pwd": "{V}"}}', f'{{"pwd": {{"value": "{V}"}}}}', f'{{"pwd":\n  "{V}"}}',
    f'{{"name": "DB_PWD", "value": "{V}"}}', f'x = "{{\\"pwd\\": \\"{V}\\"}}"',
    f"pwd: {V}", f"db:\n  pwd: |\n    {V}\n  user: someone", f"pwd: >-\n  {V}\n", f"base: &p {V}\ndb:\n  pwd: *p",
    f"pwd:\n  value: {V}\nuser:\n  value: {W}", f"env:\n  - name: DB_PWD\n    value: {V}",
    # TOML, ini, XML
    f'[database.pwd]\nvalue = "{V}"', f"[db]\npwd={V}", f"<pwd>{V}</pwd>", f'<pwd type="x">\n  {V}\n</pwd>',
    f'<add key="db.pwd" value="{V}"/>', f'<db user="me" pwd="{V}"/>',
    # constants
    f'db_pwd = FIRST\nFIRST = OTHER\nOTHER = "{V}"', f'a = b\nb = a\npwd = "{V}"',
    # addresses
    f"see https://me:{V}@host/path", f'url = "postgres://me:{V}@host:5432/db"', f'c = "Server=x;Pwd={V};"',
])
def test_secret_syntaxes(text):
    assert [text[s.start:s.end] for s in secrets.literal_spans(text)] == [V]


@pytest.mark.parametrize("text", [
    f'pwd = "{V[:8]}" + "{V[8:]}"', f'pwd = ("{V[:8]}"\n       "{V[8:]}")', f"$pwd = '{V[:8]}' . '{V[8:]}';",
    f'a = "{V[:8]}"\npwd = a + "{V[8:]}"', f'a = "{V[:8]}"\nb = "{V[8:]}"\npwd = a + b',
])
def test_secret_joined_literals(text):
    assert [text[s.start:s.end] for s in secrets.literal_spans(text)] == [V[:8], V[8:]]


@pytest.mark.parametrize("text", [
    'pwd = os.environ.get("PWD")', 'pwd = os.environ["DB_PASSWORD_PROD1"]', 'pwd = getpass("Enter the pwd of db1: ")', "DB_PWD=$RAW_VALUE_1a2b",
    'pwd = get_value("database1", region)', "pwd: *missing", "it's pwd isn't = 'it", 'if pwd == "q7Rw2ZkP9xLmT4vB":',
    'https://user:password@host', "<pwd></pwd>", 'value = "q7Rw2ZkP9xLmT4vB"', 'key = "assets/img2021/a1b2c3/file99x8.png"',
    "pwd = pwd", 'name = "pwd"\ncolor = "q7Rw2ZkP9xLmT4vB"', "", "=", "pwd =", 'pwd = "', "pwd = (", "pwd: |", "pwd: |\n", "[", "<a>",
    "token = self.special_form", 'def of(a) -> Secret:\n    """Counts after their discounts"""', "pwd = FIRST\nFIRST = pwd",
])
def test_secret_nothing_to_find(text):
    assert secrets.literal_spans(text) == []


def test_secret_lexer_in_linear_time():
    """Doubling a text about doubles the work, also where nothing is closed."""
    for part in ('\\"', '"', "'", "`", '"""', "a=", "a:", "a: b ", "<a ", "<a>", "[", "a = (", "a:|\n", "pwd = a + ", "a_b", "a=b;b=a;", " ",
                 '{"value": "a=b"},', 'a1 = "x" + a1\n', "&a ", "$a", "a:\n ", "x.y[", '"a":', "pwd=f(", "a\\\n"):
        times = []
        for size in (40_000, 160_000):
            text = part * (size // len(part))
            start = time.process_time()
            secrets.literal_spans("x = " + text)
            times.append(time.process_time() - start)
        assert times[1] < 8 * times[0] + 0.5, (part, times)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["pwd", "a", "value", "name", "=", ": ", '"', "'", "`", "\n", "  ", "(", ")", "[", "]", "{", "}", "\\", "$", "&", "*",
                                 "<", ">", "</", "|", "+", ",", "https://", "@", "é", V, '"""', "get("]), max_size=25).map("".join))
def test_secret_spans_of_any_text(text):
    spans = secrets.literal_spans(text)
    assert all(0 <= s.start < s.end <= len(text) and s.score >= secrets.THRESHOLD for s in spans)
    assert spans == sorted(set(spans))


# --- repetition -----------------------------------------------------------

def plain_repetition(text):
    own = words(text)
    places, covered = {}, set()
    for i in range(len(own) - 4):
        places.setdefault(tuple(own[i:i + 5]), []).append(i)
    for at in places.values():
        if len(at) > 1:
            covered |= {j for i in at for j in range(i, i + 5)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    n = len(own)
    return (n, sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered),
            n < 10 or 100 * len(covered) > 20 * n)


def test_repetition_counts(documents, awkward, no_documents):
    for docs in (documents, awkward, no_documents):
        found = repetition.repetition_rules(docs)
        got = rows_of(found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert got == sorted(((r.doc_id, *plain_repetition(r.text)) for r in docs.collect()), key=repr)
        assert found.where("base_failed and kept").count() == 0


def test_repetition_verdict(spark):
    fresh = " ".join(f"w{i}" for i in range(400))
    twice = " ".join(f"w{i}" for i in range(40))
    texts = [fresh, fresh + "\n" + twice, "\n".join(["only one line that is said"] * 30), "few words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in repetition.repetition_rules(docs).collect()}
    assert [got[i].kept for i in range(4)] == [True, True, False, False]
    strict = repetition.repetition_rules(docs, {5: 0.01})
    assert not strict.where("doc_id = 1").first().kept


def plain_window_share(text, n):
    """Share of the word characters inside n-word windows found twice or more."""
    own, places = words(text), {}
    for i in range(len(own) - n + 1):
        places.setdefault(tuple(own[i:i + n]), []).append(i)
    covered = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + n)}
    inside = sum(len(own[j]) for j in covered)
    return inside, inside / max(1, sum(map(len, own)))


def plain_verdict(text):
    """The whole rule: base, windows, and lines."""
    fine = not plain_repetition(text)[-1]
    for n, limit in repetition.LIMITS.items():
        inside, share = plain_window_share(text, n)
        fine &= not (share > limit and inside > repetition.ALLOWANCE)
    lines = [line for line in (text or "").split("\n") if words(line)]
    again = [line for i, line in enumerate(lines) if line in set(lines[:i])]
    size = lambda held: sum(len(w) for line in held for w in words(line))
    fine &= len(again) <= repetition.LINE_LIMIT * len(lines)
    return fine and size(again) <= repetition.LINE_CHAR_LIMIT * max(1, size(lines))


def repeated_phrases(n, share, size=3000):
    """Words of one length, the given share of them in n-word phrases that stand
    twice, each phrase apart from its copy."""
    fresh = (f"w{i:05d}" for i in range(10**5))
    phrases = [[next(fresh) for _ in range(n)] for _ in range(round(share * size / (2 * n)))]
    out = [w for p in phrases for w in [*p, next(fresh)]] + [w for p in phrases for w in [next(fresh), *p]]
    return " ".join(out + [next(fresh) for _ in range(size - len(out))])


def test_repetition_each_limit_decides_alone(spark):
    limits = repetition.LIMITS
    texts, only = [], {}
    for n, limit in limits.items():
        above = limits.get(n - 1, repetition.BASE_PERCENT / 100)
        only[len(texts)] = n
        texts += [repeated_phrases(n, (limit + above) / 2), repeated_phrases(n, limit - 0.005)]
    # short lines between others: no window is repeated, the lines are
    lines = len(texts)
    texts.append("\n".join(f"a{i} b{i}\nx{j}" for j, i in enumerate([*range(60), *range(60)])))
    texts.append("\n".join(f"a{i} b{i}\nx{j} y{j}" for j, i in enumerate([*range(30), *range(60)])))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in repetition.repetition_rules(docs).collect()}
    for i, n in only.items():
        others = {k: v for k, v in limits.items() if k != n}
        assert not got[i].base_failed and not got[i].kept and got[i + 1].kept
        assert repetition.repetition_rules(docs.where(f"doc_id = {i}"), others).first().kept
        assert abs(got[i].window_share - plain_window_share(texts[i], n)[1]) < 1e-12
    assert got[lines].window_share == 0 and not got[lines].base_failed and not got[lines].kept and got[lines + 1].kept
    assert [got[i].kept for i in range(len(texts))] == [plain_verdict(t) for t in texts]


def test_repetition_verdict_of_given_table(documents, awkward):
    for docs in (documents, awkward):
        got = rows_of(repetition.repetition_rules(docs), "doc_id", "kept")
        assert got == sorted(((r.doc_id, plain_verdict(r.text)) for r in docs.collect()), key=repr)
