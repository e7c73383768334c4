import hashlib
import random
import re
import time

from cohorte.llm.deobfuscate import normalised
from cohorte.llm.personal_data import KINDS, disguised, identifiers, luhn, personal_data, redact, redacted


def plain(text):
    """The contract's patterns, as they stand."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        out += [("card", *m.span())] if 13 <= len(d) <= 19 and luhn(d) else []
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_identifiers_are_those_of_the_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("a.@-1+ 2( b%é") for _ in range(rng.randint(0, 30)))
        assert identifiers(text) == plain(text), text


def test_disguises_map_back_to_the_source():
    cases = {
        "mail john.doe (at) example [dot] com now": ("email", "john.doe (at) example [dot] com"),
        "é write jane at mail dot example dot org please": ("email", "jane at mail dot example dot org"),
        "call plus one five five five one two three four five six seven now": ("phone", "plus one five five five one two three four five six seven"),
        "ip 192[.]168[.]1[.]7 x": ("ip", "192[.]168[.]1[.]7"),
        "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ": ("email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        "a jоhn@exаmple.com": ("email", "jоhn@exаmple.com"),  # Cyrillic o and a
        "x john dot doe at example dot com y": ("email", "john dot doe at example dot com"),
        "x john.doe@example dot co dot uk y": ("email", "john.doe@example dot co dot uk"),
        "x john_at_example_dot_com y": ("email", "john_at_example_dot_com"),
        "x john&#64;example&#46;com y": ("email", "john&#64;example&#46;com"),
        "host 192.168.O.l up": ("ip", "192.168.O.l"),
        "pay 4111 1111 1111 111l now": ("card", "4111 1111 1111 111l"),
        "pay 4111 1111 1111 one one one one now": ("card", "4111 1111 1111 one one one one"),
        "pay 4111-1111-one one one one-1111, please": ("card", "4111-1111-one one one one-1111"),
        "call +44 20 seven nine four six 0018 now": ("phone", "+44 20 seven nine four six 0018"),
        "host one nine two dot one six eight dot one dot seven up": ("ip", "one nine two dot one six eight dot one dot seven"),
        "host 10 dot zero dot 0 dot 1 up": ("ip", "10 dot zero dot 0 dot 1"),
        "a juan arroba ejemplo punto com b": ("email", "juan arroba ejemplo punto com"),
        "a jean arobase exemple point fr b": ("email", "jean arobase exemple point fr"),
        "a max at beispiel punkt de b": ("email", "max at beispiel punkt de"),
        "plus vier neun drei null eins zwei drei vier fünf sechs": ("phone", "plus vier neun drei null eins zwei drei vier fünf sechs"),
        "+٤٤ ٢٠ ٧٩٤٦ ٠٩٥٨": ("phone", "+٤٤ ٢٠ ٧٩٤٦ ٠٩٥٨"),
    }
    for text, (kind, span) in cases.items():
        assert [(k, text[a:b]) for k, a, b in disguised(text, identifiers(text))] == [(kind, span)], text
        assert redact(text) == text.replace(span, f"[{kind.upper()}]")


def test_clean_texts_have_no_disguise():
    for text in ("we met at noon dot dot dot", "un un un un un un un un un", "one two three", "the dot at the point", "created_at_utc.time", "I1 and O2 or l3, 10l", "été à noël", "we met at that point in time", "one of 4 or two of 5", "one dot two", "look at this point we 1 one", "un 2 un 3 un 4 un", "4111 1111 1111 one one one two"):
        assert disguised(text, []) == []
    assert normalised("plain words") is None


def test_long_hostile_texts_are_fast():
    began = time.time()
    for text in ("a" * 200_000, "1" * 200_000, "1 " * 100_000, "one " * 50_000, "+1" + " " * 200_000, "@" * 200_000, "a@" * 100_000, "(" * 200_000, "1." * 100_000, "one 2 dot " * 50_000, "one,2." * 50_000):
        disguised(text, identifiers(text))
    assert time.time() - began < 20


def test_messy_rows(messy):
    got = personal_data(messy).collect()
    rows = {r.doc_id: r.text for r in messy.collect()}
    assert len(got) == messy.count()
    for r in got:
        spans = sorted(plain(rows.get(r.doc_id) or ""), key=lambda s: (KINDS.index(s[0]), s[1]))
        if r.doc_id is not None:
            assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in spans) for k in KINDS)
            assert set(f"{k}:{a}:{b}" for k, a, b in spans) <= set(r.spans.split(","))
    by = {r.doc_id: r for r in got}
    assert (by[12].n_email, by[12].n_ip, by[12].n_card, by[12].n_phone) == (1, 1, 1, 1) and by[13].n_disguised == 2
    out = redacted(messy)
    assert out.schema == messy.schema
    texts = {r.doc_id: r for r in out.collect()}
    assert texts[12].text == "Mail [EMAIL] or [PHONE], card [CARD], host [IP]. MIT License." and texts[12].n_chars == len(texts[12].text)
    assert texts[8].text is None and texts[7].text == "" and texts[10].text == rows[10]


def test_empty(no_docs):
    assert personal_data(no_docs).count() == 0 and redacted(no_docs).count() == 0
