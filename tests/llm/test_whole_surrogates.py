"""All spellings of an entity get one surrogate, and entities stay distinct."""

import re

import pytest

from tidemark.llm import surrogates


def digits(t):
    return re.sub(r"\D", "", t)


def test_a_phone_number_is_one_however_grouped():
    forms = ["+49 30 12345678", "+493012345678", "+49-30-1234 5678", "+4930 12345678"]
    got = [surrogates.surrogate(b"k", "phone", x) for x in forms]
    assert len({digits(x) for x in got}) == 1 and all(x.startswith("+49") for x in got)
    assert surrogates.surrogate(b"k", "phone", "+3581234567").startswith("+358")
    many = {digits(surrogates.surrogate(b"k", "phone", f"+1 555 {i:03d} {j:04d}")) for i in range(20) for j in range(20)}
    assert len(many) == 400


@pytest.mark.parametrize("few", [0, 100_000])
def test_a_name_is_one_person(spark, few):
    rows = [
        (1, "Mr John Smith came. John Smith said so, and JOHN SMITH left; Smithson and john smithy stay."),
        (2, "Then Dr Anna Weber spoke."),
        (3, "Frau Anna Weber spoke. So did Anna Weber."),
        (4, "Here Dr John Smith works."),
    ]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r["doc_id"]: r["text"] for r in surrogates.replace_entities(df, b"k", few=few).collect()}
    assert not any(x in t for t in got.values() for x in ("John Smith ", "JOHN SMITH", "Anna Weber"))
    assert "Smithson and john smithy stay." in got[1]
    john = re.match(r"Mr (\w+ \w+) came\. (\w+ \w+) said so, and (\w+ \w+) left", got[1])
    assert john[1] == john[2] and john[3] == john[1].upper()
    assert john[1].split()[0] in surrogates.GIVEN["latin", "m"] and got[4] == f"Here Dr {john[1]} works."
    anna = re.match(r"Then Dr (\w+ \w+) spoke", got[2])[1]
    assert anna.split()[0] in surrogates.GIVEN["latin", "f"] and got[3] == f"Frau {anna} spoke. So did {anna}."


def test_sorts_of_secrets_do_not_meet():
    for i in range(200):
        low, high, other = (surrogates.surrogate(b"k", "secret", x) for x in (f"{i:08d}", f"A{i:07d}", f"z{i:07d}"))
        assert re.fullmatch("[0-9a-f]{8}", low) and high.isupper() and not re.fullmatch("[0-9a-f]+|[0-9A-F]+", other)


def entities(rng):
    """Many entities of each kind, several spellings of some, in three scripts and genders."""
    out = {"email": [], "phone": [], "card": [], "ssn": [], "ip": [], "iban": [], "secret": []}
    for i in range(150):
        out["email"] += [f"user{i}@mail{i % 7}.example.org", f"User{i}@mail{i % 7}.example.org"]
        n = f"{rng.integers(10**9, 10**10 - 1)}"
        out["phone"] += [f"+49 {n[:3]} {n[3:]}", f"+49{n}", f"({n[:3]}) {n[3:6]}-{n[6:]}"]
        out["ssn"].append(f"{n[:3]}-{n[3:5]}-{n[5:9]}")
        body = n + "12345"
        card = body + str(surrogates._luhn(body))
        out["card"] += [card, " ".join(card[k : k + 4] for k in range(0, 16, 4))]
        out["ip"] += [f"10.0.{i}.{i % 9}", f"8.8.{i}.1", f"192.168.{i}.7"]
        out["iban"].append(f"DE{10 + i % 80}{n}00000000"[:22])
        out["secret"] += [f"{n}abcdef{i:06d}xyz", f"{i:032x}"]
    return out


def test_brute_force_of_distinctness_and_coreference():
    import numpy as np

    for kind, said in entities(np.random.default_rng(11)).items():
        meant = {}
        for text in dict.fromkeys(said):
            known, got = surrogates.canonical(kind, text), surrogates.surrogate(b"k", kind, text)
            assert surrogates.canonical(kind, got) != known, (kind, text, got)
            assert kind == "ip" or [c.isalnum() for c in got] == [c.isalnum() for c in text]
            meant.setdefault(known, set()).add(surrogates.canonical(kind, got))
        assert all(len(x) == 1 for x in meant.values()), kind  # coreference
        assert len(set.union(*meant.values())) == len(meant), kind  # distinctness


@pytest.mark.parametrize("size", [2, 3, 10, 257, 1000])
def test_permutations_have_no_fixed_points(size):
    p = surrogates.Permutation(b"k", "t", size)
    assert sorted(map(p, range(size))) == list(range(size)) and all(p(x) != x for x in range(size))


def test_names_are_distinct_in_scripts_and_genders(spark):
    said = {"m": ["Mr", "Herr", "г-н"], "f": ["Mrs", "Frau", "г-жа"]}
    said = {g: [t for t in ts if t in surrogates.TITLES] for g, ts in said.items()}
    names = [f"{a} {b}" for a in ("Anna", "Otto", "Élise", "Иван", "Мария", "Νίκος") for b in ("Weber", "Smith", "Петров", "Παππάς")]
    rows = [(i, f"{said[g][i % len(said[g])]} {n} came. Then {n} left.") for i, (n, g) in enumerate((n, g) for n in names for g in "mf")]
    got = {r["doc_id"]: r["text"] for r in surrogates.replace_entities(spark.createDataFrame(rows, "doc_id int, text string"), b"k").collect()}
    person = {}
    for i, text in rows:
        name = re.search(r" (\S+ \S+) came", text)[1]
        a, b = re.search(r" (\S+ \S+) came\. Then (\S+ \S+) left", got[i]).groups()
        assert a == b != name and surrogates.script_of(a.split()[-1]) == surrogates.script_of(name)
        person.setdefault(name, set()).add(a)
    assert all(len(x) == 1 for x in person.values()) and len(set.union(*person.values())) == len(names)


@pytest.mark.parametrize("few", [0, 100_000])
def test_family_names_and_possessives(spark, few):
    """The 's stays, and a person's family name is one, with a given name and without, in one text and in others."""
    rows = [
        (1, "Mr. Smith's son. Smith said. Smith’s car."),
        (2, "Dr. Anna Smith came. Dr. Smith left. Ms Smith spoke. Then Smith slept; blacksmith work, a smith."),
        (3, "Patient: Maria Garcia, DOB 01/02/1980. Garcia left."),
        (4, "Contact: Dr. O'Neill-Weber. O'Neill-Weber's desk."),
    ]
    got = {r["doc_id"]: r["text"] for r in surrogates.replace_entities(spark.createDataFrame(rows, "doc_id int, text string"), b"k", few=few).collect()}
    assert not any(x in t for t in got.values() for x in ("Smith", "Anna", "Garcia", "Maria", "Neill"))
    family = re.fullmatch(r"Mr\. (\w+)'s son\. (\w+) said\. (\w+)’s car\.", got[1]).groups()
    assert len(set(family)) == 1
    two = re.fullmatch(r"Dr\. \w+ (\w+) came\. Dr\. (\w+) left\. Ms (\w+) spoke\. Then (\w+) slept; blacksmith work, a smith\.", got[2]).groups()
    assert set(two) == set(family)
    assert re.fullmatch(r"Patient: \w+ (\w+), DOB 01/02/1980\. \1 left\.", got[3]) and re.fullmatch(r"Contact: Dr\. (\w+)\. \1's desk\.", got[4])


def test_full_names_of_a_family_stay_apart(spark):
    """More given names in one family than the lists have: all full names end distinct, and the family is one."""
    rows = [(i, f"Mr Al{chr(97 + i // 26)}{chr(97 + i % 26)} {f} came. {f} left.") for i, f in ((i, f) for i in range(60) for f in ("Ray", "Fox"))]
    again = {r["name"]: r["attempt"] for r in surrogates.redrawn_names(spark.createDataFrame(rows, "doc_id int, text string"), "text", b"k").collect()}
    made = [surrogates.Replacer(b"k", again)(t)[0] for _, t in rows]
    full = [re.fullmatch(r"Mr (\w+ (\w+)) came\. \2 left\.", t) for t in made]
    assert all(full) and len({m[1] for m in full}) == 120 and len({m[2] for m in full}) == 2 and again
