import pytest
from claimloom.llm.residue import has_placeholder, line_hash, line_kind, masked, page_kind, repaired, residue, rule_kind

BODY = "The narrow valve rejected 57 records near Gracktru, while two committees compared notes about it for the rest of the day."


@pytest.mark.parametrize("text", ["Dear {{first_name}}, your order", "Hola [[CITY]], x", "to ${customer.email}.", "Hallo %phone%, y", "<%= PHONE %> z", "*|product_title|* | pump", "@@amount@@ a", "#{slug}", "Welcome to __city__!", "尊敬的{slug}，金平", "by [INSERT date HERE]", "[your city]", "Order <amount> of", "<<author>>", "{% phone %}"])
def test_placeholders(text):
    assert has_placeholder(text)


@pytest.mark.parametrize("text", ["In this engine a name is written as {{ price }} and the mill fills it in.", "The manual says that ${city} is read from the shell, for example ${city}/W.", "Fields like [slug] or %slug% in a letter are\nreplaced by the mail gateway.", "The set {1, 2, 3} and [4] and [see dremjeer], with %20 in <b>it</b>.", "19% minutes and 20% of"])
def test_no_placeholders(text):
    assert not has_placeholder(text)


def test_lines():
    assert line_kind(masked("Error 502: Bad Gateway")) == line_kind(masked("404 Not Found")) == line_kind(masked("Not Found (code 404)")) == "error"
    assert rule_kind(masked("Blah blah blah blah. Blah blah blah blah."), False) == "filler"
    assert line_kind(masked("Lorem ipsum amet ipsum mollit ipsum commodo veniam mollit")) == "filler"
    assert rule_kind(masked("Seite nicht gefunden"), False) == "error" and line_kind(masked(BODY)) is None


def test_wrong_charsets():
    want = "Для работы сайта включите JavaScript в браузере."
    for sent, declared in (("utf-8", "cp1252"), ("cp1251", "ISO-8859-1"), ("koi8-r", "windows-1252"), ("utf-8", "latin-1")):
        garbled = want.encode(sent).decode(declared, "replace")
        assert page_kind(f"{garbled}\n© 2020 zivo", set(), declared)[0] == "message", (sent, declared)
    for fine in ("Für die Größe über Äpfel", BODY, want, "", "ÄÖÜ"):
        assert repaired(fine, "no-such-charset") == fine and repaired(fine, None) == fine
    assert repaired("Für die Größe über Äpfel", "cp1252") == "Für die Größe über Äpfel"


def test_pages():
    assert page_kind(f"Home\nPage not found\nThe page you asked for has moved or never existed.\n© 2020 zivo", set())[0] == "message"
    assert page_kind(f"{BODY}\nPage not found was the commonest message last year.\n{BODY}", set()) is None
    assert page_kind(f"{BODY}\nComments need JavaScript.", set()) is None
    assert page_kind(f"{BODY}\n" + "Your text goes here.\n" * 4, set())[0] == "filler"
    assert page_kind("Title words\nfoo bar", set()) is None


def test_operator(spark):
    rows = [(i, f"Shop\n{BODY}", f"h{i}") for i in range(6)] + [(10, "Shop\nAccess denied\nAccess denied", "x"), (11, None, "x"), (12, "", None), (13, BODY * 3000 + "\nAccess denied", "y"), (10, "Shop\nAccess denied\nAccess denied", "x")]
    d = spark.createDataFrame([(a, b, c, 1.0) for a, b, c in rows], "doc_id bigint, text string, host string, share double")
    assert [(r.doc_id, r.kind) for r in residue(d).collect()] == [(10, "message")]
    assert residue(d.limit(0)).count() == 0


@pytest.mark.parametrize("line", ["Sorry, we couldn't locate the page you were looking for.", "Unfortunately this document has been removed by its owner.", "Service temporarily unavailable, please come back in an hour.", "Die angeforderte Datei existiert nicht.", "La page que vous cherchez est introuvable.", "El recurso solicitado no está disponible.", "Pagina non trovata", "Доступ к этой странице запрещён.", "您要找的页面不存在", "お探しのページは見つかりませんでした。", "You must switch on JavaScript before this shop can open.", "Ative o JavaScript para continuar.", "Your paragraph text goes here", "Contenido próximamente", "foo foo foo foo"])
def test_unlisted_messages_are_told_by_their_words(line):
    key = masked(line)
    for recurring in (set(), {line_hash(key)}):
        assert page_kind(f"Home\n{line}\n© 2020 zivo", recurring) is not None


@pytest.mark.parametrize("line", ["Usamos cookies propias. Aceptar todo | Ajustes", "This site uses cookies to keep the lamps on. Accept all | Settings", "By browsing on you agree to our use of cookies. OK", "“Page not found” was the commonest message last year.", "Report a problem", "We value your privacy. Choose which cookies we may set."])
def test_furniture_and_talk_of_messages_stay(line):
    assert rule_kind(masked(line), True) is None and page_kind(f"{line}\n{BODY}", {line_hash(masked(line))}) is None


def test_widely_recurring_message(spark):
    d = spark.createDataFrame([(i, "Shop\nThe article you wanted was withdrawn by our editors.", f"h{i}", "s") for i in range(6)] + [(9, f"Shop\n{BODY}", "x", "s")], "doc_id bigint, text string, host string, source string")
    assert sorted((r.doc_id, r.kind) for r in residue(d).collect()) == [(i, "message") for i in range(6)]


def test_furniture_is_told_by_recurrence_and_extra_columns_do_no_harm(spark):
    """A menu line of many pages is no body, at any length; the same line on one host is."""
    menu = "All the news from our harbour towns, every morning, straight from the people who live and work there."
    rows = [(i, f"{menu}\nAccess denied", f"h{i % 4}", "utf-8", i, "x", True) for i in range(8)] + [(20 + i, f"{menu} Really.\nAccess denied", "one", None, i, "x", False) for i in range(8)]
    rows += [(40, "<<name>>", None, "cp1251", 0, None, None), (41, None, None, None, 0, None, None), (0, f"{menu}\nAccess denied", "h0", "utf-8", 1, "x", True)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, host string, declared_charset string, line bigint, kind string, placeholder boolean")
    assert sorted((r.doc_id, r.kind) for r in residue(d).collect()) == [*((i, "message") for i in range(8)), (40, "placeholder")]
