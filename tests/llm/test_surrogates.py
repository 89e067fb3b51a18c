"""Surrogates: format, distinctness, coreference, and that no entity stays."""

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracery.llm import surrogates as s

KEY = b"key"
EXAMPLES = {
    "email": "Jane.Doe+x@mail.example.org", "secret": "sk-abcdefghij0123456789", "iban": "DE89 3704 0044 0532 0130 00", "ipv4": "192.168.10.254", "ipv6": "2001:0db8:85a3:0000:0000:8a2e:0370:7334",
    "ssn": "123-45-6789", "card": "4111 1111 1111 1111", "phone": "+49 30 1234 5678", "name": "Mrs. Anna Müller",
}


@pytest.mark.parametrize("kind", EXAMPLES)
def test_each_kind(kind):
    text = f"see {EXAMPLES[kind]}, please"
    assert [(k, text[a:b]) for a, b, k in s.find(text)] == [(kind, EXAMPLES[kind])]
    new, n = s.rewrite(text, KEY)
    mention = new[4:-8]
    assert n == 1 and new.startswith("see ") and new.endswith(", please") and EXAMPLES[kind] not in new
    assert re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "0", mention)) == re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "0", EXAMPLES[kind])) or kind in ("name", "ipv4", "ipv6", "secret")
    assert [k for _, _, k in s.find(new)] == [kind]
    assert s.rewrite(text, KEY) == (new, 1) and s.rewrite(text, b"other")[0] != new


def test_card_keeps_its_check_digit():
    rng = random.Random(7)
    for _ in range(50):
        body = "".join(rng.choice("0123456789") for _ in range(15))
        card = body + next(d for d in "0123456789" if s.luhn(body + d))
        assert s.luhn(s.surrogate("card", card, KEY))


def test_one_entity_has_one_surrogate_however_it_is_written():
    spaced, plain = s.rewrite("4111 1111 1111 1111", KEY)[0], s.rewrite("4111111111111111", KEY)[0]
    assert spaced.replace(" ", "") == plain
    assert s.rewrite("ANNA@X.ORG", KEY)[0].lower() == s.rewrite("anna@x.org", KEY)[0]
    long, short = s.rewrite("Mr. John Smith", KEY)[0], s.rewrite("Mr. Smith", KEY)[0]
    assert long.split()[-1] == short.split()[-1]


def test_gender_and_script():
    for title, names in (("Mr.", s.MALE_NAMES), ("Frau", s.FEMALE_NAMES)):
        for given_name in names[:10]:
            assert s.rewrite(f"{title} {given_name} Meier", KEY)[0].split()[1].lower() in {n.lower() for n in names}
    greek = s.rewrite("Dr. Παπαδόπουλος", KEY)[0].split()[1]
    assert all("Ͱ" <= c <= "Ͽ" for c in greek) and greek[0].isupper()


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=4))
def test_permutation(radices):
    p = s.Permutation(KEY, "x")
    size = 1
    for r in radices:
        size *= r
    images = [p.number(x, radices) for x in range(min(size, 3000))]
    assert len(set(images)) == len(images) and all(0 <= y < size for y in images)
    assert size < 2 or all(y != x for x, y in enumerate(images))


@settings(deadline=None)
@given(st.text() | st.text(st.sampled_from("a1@.-+ :/('\"=skMr_é\n"), max_size=60))
def test_any_text(text):
    new, n = s.rewrite(text, KEY)
    assert (new == text) == (n == 0) or n > 0


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in s.surrogates(docs, KEY).collect()}
    old = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(old) and sum(r.n_entities for r in rows.values()) > 20
    names = {}
    for k, text in old.items():
        found = s.find(text)
        assert rows[k].n_entities == len(found)
        if not found:
            assert rows[k].text == text
        at, rest = 0, rows[k].text
        for a, b, kind in found:  # what is no entity stays
            assert rest.startswith(text[at:a])
            rest, at = rest[a - at :], b
            if kind in ("card", "ssn", "iban", "phone", "email"):
                new = rest[: b - a]
                assert new != text[a:b]
                key = (kind, s.canonical(kind, text[a:b]))
                assert names.setdefault(key, s.canonical(kind, new)) == s.canonical(kind, new)
                rest = rest[b - a :]
            else:
                break
    assert len({(k[0], v) for k, v in names.items()}) == len(names)
    assert not {(k[0], v) for k, v in names.items()} & set(names)


def test_collisions_are_keyed_anew(spark):
    first = s.surrogate("ssn", "123456789", KEY)
    other = f"{first[:3]}-{first[3:5]}-{first[5:]}"
    docs = spark.createDataFrame([(1, f"id 123-45-6789 and {other}"), (2, "again 123-45-6789")], "doc_id long, text string")
    for bound in (50_000, 0):  # tasks hold the colliding entities, or a join brings them
        got = {r.doc_id: r.text for r in s.surrogates(docs, KEY, bound=bound).collect()}
        one, two = re.findall(r"\d{3}-\d{2}-\d{4}", got[1])
        assert one == got[2].split()[-1] and len({one, two, other, "123-45-6789"}) == 4


def test_names_that_collide_are_keyed_anew(spark):
    words = [c + v for c in "bdfglm" for v in "aeiou"]  # a quarter of the 105 images are real names
    docs = spark.createDataFrame([(k, f"Mr. {w.capitalize()} is here") for k, w in enumerate(words)] + [(99, "Mr. 李明 is here")], "doc_id long, text string")
    for bound in (50_000, 0):
        new = {r.doc_id: r.text.split()[1].lower() for r in s.surrogates(docs, KEY, bound=bound).collect()}
        assert len(set(new.values())) == len(words) + 1 and not set(new.values()) & {*words, "李明"}
    assert not {n.lower() for n in (*s.MALE_NAMES, *s.FEMALE_NAMES)} & set(new.values())


def test_settled_entities_keep_their_surrogate(spark, monkeypatch):
    """c's new surrogate is that of a settled entity that sorts after it."""
    known = {("c", 0): "z", ("z", 0): "q", ("y", 0): "k", ("c", 1): "k", ("c", 2): "w"}
    table = spark.createDataFrame([("ssn", x, known[x, 0]) for x in "czy"], "kind string, entity string, surrogate string")
    given_table = [table, lambda df, tweak: spark.createDataFrame([(r.kind, r.entity, known[r.entity, tweak]) for r in df.collect()], table.schema)]
    monkeypatch.setattr(s, "run_arrow", lambda df, f, schema, **kw: table if f is s._entities else given_table[1](df, f.keywords["tweak"]))
    got = {(r.entity, r.tweak) for r in s.collisions(spark.createDataFrame([("x",)], "text string"), KEY).collect()}
    assert got == {("c", 2)}


def test_untitled_repeats_of_a_name():
    text = "Mrs. Anna Müller came. Anna  Müller sat; ANNA MÜLLER's hat, Müller’s coat and Anna. An annals entry."
    new, n = s.rewrite(text, KEY)
    first, last = new.split()[1:3]
    last = last.rstrip(".")
    assert new == f"Mrs. {first} {last} came. {first}  {last} sat; {first.upper()} {last.upper()}'s hat, {last}’s coat and {first}. An annals entry."
    assert n == 5 and "anna " not in new.lower() and "müller" not in new.lower()


def test_who_is_found():
    """Probes: untitled mentions, names of the title's gender, national numbers, and numbers that are nobody's."""
    new, n = s.rewrite("Mr John Smith said. John Smith said.", KEY)
    assert n == 2 and "John" not in new and "Smith" not in new and new.split()[1:3] == new.split()[4:6]
    mrs, mr = s.rewrite("Mrs Fiona Brown", KEY)[0].split(), s.rewrite("Mr Kevin Brown", KEY)[0].split()
    assert mrs[2] == mr[2] and all(x in s.SURNAMES for x in mrs[2].split("-"))
    assert all(x in s.FEMALE_NAMES for x in mrs[1].split("-")) and all(x in s.MALE_NAMES for x in mr[1].split("-"))
    both = s.rewrite("Dr Fiona Brown, that is Mrs Fiona Brown", KEY)[0].replace(",", "").split()
    assert both[1:3] == both[6:8]
    assert [k for _, _, k in s.find("call 07700 900123 or 0211 123 4567")] == ["phone", "phone"]
    assert [(k, a) for a, _, k in s.find("Passport No: X1234567 and passport 123456789")] == [("passport", 13), ("passport", 35)]
    assert not s.find("version 1.2.3.4, v10.20.30.40, order 1234567890123 and 4111111111111112, passport photo")
    assert [k for _, _, k in s.find("my visa card 4111111111111112, host 1.2.3.4")] == ["card", "ipv4"]


def test_long_texts_take_linear_time():
    text = " ".join(f"user{k}@host{k % 97}.org 10.{k % 200}.{k % 99}.7 +1 555 {k % 900 + 100} 4567" for k in range(30_000))
    began = time.process_time()
    assert len(s.find(text)) == 90_000
    assert time.process_time() - began < 20


def test_the_key_has_no_default(spark):
    with pytest.raises(TypeError):
        s.surrogates(spark.createDataFrame([("x",)], "text string"))
    assert s.session_key(spark) != s.session_key(spark)


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, "nothing here"), (4, "mail a.b@c.org"), (4, "mail a.b@c.org"), (None, "call +1 555 123 4567"), (5, "x@y.org " * 20_000)]
    docs = spark.createDataFrame([(*r, 9, "k") for r in rows], "doc_id long, text string, n_entities int, kind string")
    got = s.surrogates(docs, KEY).collect()
    assert len(got) == len(rows) and sorted(r.n_entities for r in got) == [0, 0, 0, 1, 1, 1, 20_000]
    assert {r.kind for r in got} == {"k"} and len({r.text for r in got if r.doc_id == 4}) == 1
    assert s.surrogates(docs.limit(0), KEY).count() == 0
