"""Golden rows of the extraction."""

from foliant.operators import extraction as X


def said(text):
    return {(r.subject, r.predicate, r.object or r.literal) for r in X.Reading(text, X.entities(text)).relations()}


def test_people_have_titles_and_one_normal_form():
    found = X.people("Capitão Antonio Benedicto d'Araujo Pernambuco compareceu ao acto com João Affonso Botelho.")
    assert [(e.name, e.role) for e in found] == [("Antonio Benedicto d'Araujo Pernambuco", "Capitão"), ("João Affonso Botelho", "")]
    assert X.plain_name("Antonio Benedicto d'Araujo") == X.plain_name("Antonio Benedito de Araujo")
    assert found[0].confidence == 0.91 and "João Afonso Botelho" in found[1].aliases
    assert X.people("") == [] and X.people("Companhia Pernambucana de Navegação") == []


def test_institutions_and_places():
    text = "João Affonso Botelho compareceu à Associação Commercial do Recife em Olinda, na Rua Nova, no Sul."
    assert [e.name for e in X.institutions(text)] == ["Associação Commercial do Recife"]
    assert [e.name for e in X.places(text)] == ["Olinda"]


def test_family_and_membership():
    text = "João Affonso Botelho, filho de Manoel Botelho, compareceu ao acto. João Affonso Botelho e sua esposa Maria Thereza Botelho assinaram o requerimento."
    assert {("João Affonso Botelho", "child_of", "Manoel Botelho"), ("João Affonso Botelho", "spouse_of", "Maria Thereza Botelho")} <= said(text)
    assert any(p == "mentioned_with" and "Manoel Botelho" in (s, o) for s, p, o in said(text))
    got = said("João Affonso Botelho, sócio da Associação Commercial do Recife, morador em Olinda, requereu certidão.")
    assert ("João Affonso Botelho", "member_of", "Associação Commercial do Recife") in got and ("João Affonso Botelho", "resident_of", "Olinda") in got


def test_appointments_deaths_travels_signatures():
    got = said("João Botelho, nomeado para o cargo de Inspector da Alfandega. Falleceu hontem; falleceu o Manoel Pereira. Anna Lima embarcou para Recife. Assignado, e assignado por José Barros.")
    kinds = {p: o for _, p, o in got}
    assert "Inspector" in kinds["appointed_to"] and kinds["traveled_to"] == "Recife"
    assert ("Manoel Pereira", "deceased", "deceased") in got and ("José Barros", "signed_by", "signed by") in got


def test_badly_read_text_and_cut_names():
    got = said("João Affonso Botelho FILHO DE Manoel da Costa, e mais")
    assert ("João Affonso Botelho", "child_of", "Manoel Costa") in got
    assert X.cut_off("João Aff") and X.cut_off("João Brtx") and not X.cut_off("João Lima") and X.cut_off("")


def test_identities():
    text = "Capitão João Botelho compareceu à Associação Commercial do Recife."
    found = X.entities(text)
    key, status, _, hints = X.identity(next(e for e in found if e.type == "person"), found, "1889")
    assert "title:capitao" in key and "inst:associacao commercial do recife" in key and status == "contextual"
    found = X.entities("João Botelho compareceu com Manoel Botelho ao acto oficial.")
    assert X.identity(found[0], found, None)[:2] == ("joao botelho::family:manoel botelho", "contextual")
    found = X.entities("João Botelho compareceu ao acto oficial.")
    assert X.identity(found[0], found, "1889")[:2] == ("joao botelho::year:1889", "ambiguous")
    assert X.identity(found[0], found, "?")[:2] == ("joao botelho", "resolved")


def test_facts_of_rows(spark):
    rows = [(1, "João Affonso Botelho, filho de Manoel Botelho.", "1889", "x"), (1, "João Affonso Botelho, filho de Manoel Botelho.", "1889", "x"), (2, None, None, "x"), (3, "", "?", "x")]
    got = X.facts(spark.createDataFrame(rows, "doc_id long, text string, ano string, entities string"), "doc_id", "text", "ano").collect()
    assert sorted((r.id, len(r.entities), len(r.relations)) for r in got) == [(1, 2, 2), (1, 2, 2), (2, 0, 0), (3, 0, 0)]
