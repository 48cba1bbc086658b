from claimloom.llm.sentences import FAN, boundaries, sentence_ends, sentence_ends_chunked, sentences
from hypothesis import given, settings
from hypothesis import strategies as st

# Sentences as they must come out.
CASES = [
    ["Dr. Rilex measured 918 dreamo per sec. at approx. 62 units.", "No. 17 of X, i.e. the panel, cost $4.50."],
    ["The host api.nirpla.example answered in 25.8 s (see sec. 4.2 of it).", "The shift ended at 5 p.m.", "A new one began!"],
    ["Why did A and B (the wide pair!) leave the pump?!", "J. K. Rowan left ... then came back."],
    ["“The survey stopped. Restart it now!” said Tinea to the mirror.", 'Keta asked: "Did it fail?"', "Yes."],
    ["Die Nr. 12 ging an Bo usw.", "Am 3. Mai zählte er z. B. bzw. ca. 3,5 Stück."],
    ["„Der Motor steht. Bitte neu starten!“, sagte Lo im Haus.", "Warum?"],
    ["« Le nutrux est en panne. Relancez-le ! » a dit Cé au convoi.", "M. Séno a vu la p. 12 et la fig. 3."],
    ["¡El faro, p. ej. el espejo, volvió!", "«El faro falló. ¡Reinicie ya!», dijo Né.", "¿Por qué la Dra. Lu guarda 10?"],
    ["В 2025 г. Жашуха проверил нутяник, т. е. насос.", "Цена 3,5 тыс. руб. за лир и т. д. устроила Вепе.", "«Стоп. Где он?» — спросил Ли."],
    ["木高说：“线清坏了。请重启！”然后离开门古二。", "“站北在海安吗？”", "版本2.4.1的高为0.75，正常……", "好。"],
    ["サウは「タイが止まった。再開して！」とナオに言った。", "「ナエはどこ？」", "値は3.14だ。"],
    ["डॉ. घित ने 3.5 साटा रखा।", "“ मेतपु बंद है। फिर चलाओ!” सेती ने कहा।"],
    ["قال د. صينما إن كوزيصا يساوي 3.5 في كينين.", "هل وصل جاتول؟"],
    ["ระบบ2.4.1ของมู", "รุ่นดี"],
]


def parts(text):
    out, b = [], 0
    for e in sentence_ends(text):
        out.append(text[b:e].strip())
        b = e
    return out


def test_rules():
    for case in CASES:
        glue = "" if "一" <= case[0][0] <= "鿿" or "ぁ" <= case[0][0] <= "ヿ" else " "
        assert parts(glue.join(case)) == case
        assert parts("\n" + "\n".join(case) + " \n") == case if "ระบบ" not in case[0] else True


def test_edges():
    assert sentence_ends(None) == sentence_ends("") == sentence_ends(" \n ") == []
    assert parts("one\ntwo; three") == ["one\ntwo; three"]
    assert parts("nightly goods.The host came.") == ["nightly goods.", "The host came."]
    assert parts('"A stopped. B began."') == ["\"A stopped.", "B began.\""]
    assert sentence_ends("a: b. c; d: e", listed=True) == [13]
    assert parts("“Never closed. Two") == ["“Never closed.", "Two"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB.!?…\"“”«»() \n。一1,", max_size=60), st.integers(1, 17))
def test_chunks_compose_to_the_whole(text, chunk):
    assert sentence_ends_chunked(text, chunk) == sentence_ends(text)


def test_spark_paths_agree(make_nodes):
    long = " ".join(" ".join(c) for c in CASES[:9]) * 40
    n = make_nodes(
        {"id": "A", "claim": "One. Two!", "context": None},
        {"id": "a ", "claim": "One. Two!", "context": None},
        {"id": "b", "claim": "port: a.; host: b.", "context": long},
        {"id": "c", "claim": None, "context": "  "},
        {"id": None, "claim": "x."},
    )
    want = {("a", "claim", 4), ("a", "claim", 9), ("b", "claim", 18)} | {("b", "context", e) for e in sentence_ends(long)}
    assert {tuple(r) for r in boundaries(n).collect()} == want
    # the long path: chunk functions in parallel, then the scan
    assert {tuple(r) for r in boundaries(n, chunk=700).collect()} == want
    # more chunks than one step of the scan composes, and quotations longer than a chunk
    assert {tuple(r) for r in boundaries(n, chunk=190).collect()} == want and len(long) > 190 * FAN
    assert boundaries(n).count() == len(want) and boundaries(n.limit(0)).count() == 0
    s = {(r.id, r.field, r.sent_no): r.sentence for r in sentences(n).collect()}
    assert s[("a", "claim", 1)] == "Two!" and len(s) == len(want)
