"""Ad extraction against expected values; all ads, people and firms are invented."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fitweave.functions import text as T
from fitweave.operators import metadata, quality, seniority, structure

SCHEMA = "job_id string, content string, source_filename string, source_url string"

# one ad per rule: (content, expected fields)
ADS = {
    "quoted_headings": (
        "> #### Arbeitsort\n>\n> Sandhafen\n>\n> #### Anstellungsart\n>\n> Teilzeit\n>\n"
        "> Veröffentlichungsdatum: Montag früh\n\nThe crew and you share the work, and we like remote days with you in our team.",
        {"location": "Sandhafen", "employment_type": "Teilzeit", "published_text": "Montag früh", "language": "en", "company": None},
    ),
    "map_link": ("[Moorbach, Österreich](https://www.google.at/maps/place/Moorbach)", {"location": "Moorbach, Österreich"}),
    "definition_list": ("\nBeschäftigungsart\n:   Teilzeit, befristet\n", {"employment_type": "Teilzeit", "contract_term": "befristet"}),
    "below_title": ("# Segelnäher (m/w/d)\n\nVerein Alte Takelage (VAT)\n\nSandhafen\n\n## **INFORMATIONEN**\n\nVAT\n", {"company": "Verein Alte Takelage (VAT)"}),
    "text_header": (
        "Zweite\nBootsbauerin\n(w/m/d)\nPlankwerk GmbH\nSo arbeiten wir\nMoorbach\nBürostandorte\nVollzeit\n",
        {"title": "Zweite Bootsbauerin (w/m/d)", "company": "Plankwerk GmbH", "location": "Moorbach", "employment_type": "Vollzeit"},
    ),
    "compact_header": (
        "Leuchtturmwart (m/w/d)\nNordlicht Dienste · Sandhafen (Hybrid)\n\nÜber den Turm\n",
        {"title": "Leuchtturmwart (m/w/d)", "company": "Nordlicht Dienste", "location": "Sandhafen", "work_model": "Hybrid"},
    ),
    "inline_values": (
        "\nArbeitsort Moorbach\nAnstellungsart Teilzeit\nBefristung befristet bis Jahresende\n",
        {"location": "Moorbach", "employment_type": "Teilzeit", "contract_term": "befristet bis Jahresende"},
    ),
    "commute_time": (
        "\nArbeitsort\n12 Minuten ab Fischmarkt\nJob address\nKaistraße 7, 09999 Sandhafen\n",
        {"location": "Kaistraße 7, 09999 Sandhafen"},
    ),
    "markdown_title": ("\n# Knotenlehrer\n\nWir suchen dich für unser Team und die Werft, mit Herz.\n", {"title": "Knotenlehrer", "language": "de"}),
    "short": ("Knotenlehrer\nMoorbach", {"language": None, "title": None}),
    "late_type": ("\n".join(f"Zeile {n} ohne Angabe" for n in range(60)) + "\nTeilzeit\n", {"employment_type": None}),
    "early_type": ("\n".join(f"Zeile {n} ohne Angabe" for n in range(39)) + "\nTeilzeit\n", {"employment_type": "Teilzeit"}),
    # names below the header are body text
    "late_company": ("\n".join(f"Absatz {n}" for n in range(40)) + "\nTakelwerk GmbH\n", {"company": "Takelwerk GmbH", "title": None}),
    "company_ends_header": ("\n".join(f"Absatz {n}" for n in range(14)) + "\nTakelwerk GmbH\n", {"title": " ".join(f"Absatz {n}" for n in range(14))}),
    "company_after_header": ("\n".join(f"Absatz {n}" for n in range(15)) + "\nTakelwerk GmbH\n", {"title": None}),
    "partner_in_body": (
        "# Seilmeister\n" + "\n".join(f"Das ist Satz {n} über das Spleißen." for n in range(31)) + "\nUnser Partner Muster SE hilft dem Team.\n",
        {"title": "Seilmeister"},
    ),
    "place_in_body": (
        "# Seilmeister\nWerft Nord\n" + "\n".join(f"Das ist Satz {n} über das Spleißen." for n in range(20)) + "\nFrag nach Fee · Moorbach (hybrid) dazu\n",
        {"title": "Seilmeister", "location": None},
    ),
}


def test_metadata(spark):
    frame = spark.createDataFrame([(k, content, None, None) for k, (content, _) in ADS.items()], SCHEMA)
    found = {r["job_id"]: r.asDict() for r in metadata.with_metadata(frame).collect()}
    wrong = {(k, f): (found[k][f], v) for k, (_, fields) in ADS.items() for f, v in fields.items() if found[k][f] != v}
    assert not wrong


@pytest.mark.parametrize(
    ("words", "language"),
    [("the and you with our", "en"), ("und der die mit für", "de"), ("the und", None), ("", None)],
)
def test_language(spark, words, language):
    frame = spark.createDataFrame([(words,)], "t string")
    assert frame.select(metadata.detect_language(F.col("t"))).first()[0] == language


def _structure(spark, texts: dict[str, str]):
    frame = spark.createDataFrame(list(texts.items()), "job_id string, content string")
    return {r["job_id"]: r for r in structure.with_structure(frame).collect()}


def test_sections_priorities_and_years(spark):
    found = _structure(spark, {
        "sections": "# Böttcher\n\n## Deine Aufgaben\n\n- Fässer für den Keller bauen\n- Reifen auf Fässer treiben\n\n"
                    "## Das bringst du mit\n\n- Mindestens vier Jahre Erfahrung mit Eichenholz\n- Idealerweise ein Führerschein\n\n"
                    "## Wir bieten\n\n- Freies Wasser im Keller\n",
        "opener": "**As part of the barrel crew, you will:**\n- Bend staves over the fire\n- Check every barrel twice\n",
        "range": "## Anforderungen\n- Mindestens 6 bis 8 Jahre Berufserfahrung",
        "wording": "## Qualifikation\n\n**Folgende Qualifikationen sind notwendig:**\n\n- Umgang mit dem Hobel\n\n"
                   "**Folgende Qualifikationen sind wünschenswert:**\n\n- Kenntnisse der Weinlagerung\n",
        "continued": "## Anforderungen\n\n- Abschluss als Böttcher oder\n  eine Lehre in der Tischlerei\n",
        "plain": "Fässer sind rund.\n- ein Punkt ohne Abschnitt\n",
    })
    first = found["sections"]
    assert [a["activity"] for a in first["activities"]] == ["Fässer für den Keller bauen", "Reifen auf Fässer treiben"]
    assert [(r["requirement"], r["priority"], r["normalized_value"]) for r in first["requirements"]] == [
        ("Mindestens 4 Jahre Berufserfahrung", "must", "min_years:4"), ("Eichenholz", "must", None),
        ("Idealerweise ein Führerschein", "nice_to_have", None),
    ]
    assert [b["benefit"] for b in first["benefits"]] == ["Freies Wasser im Keller"]
    assert [a["activity"] for a in found["opener"]["activities"]] == ["Bend staves over the fire", "Check every barrel twice"]
    assert [r["normalized_value"] for r in found["range"]["requirements"]] == ["min_years:6"]
    assert [r["priority"] for r in found["wording"]["requirements"]] == ["must", "nice_to_have"]
    assert [r["requirement"] for r in found["continued"]["requirements"]] == ["Abschluss als Böttcher oder eine Lehre in der Tischlerei"]
    assert found["plain"]["requirements"] == found["plain"]["activities"] == found["plain"]["benefits"] == []


def test_nothing_is_cut_from_long_ads(spark):
    lines = [f"- Werkstück {n} mit Nummer w{n} prüfen" for n in range(1000)]
    words = " ".join(f"wort{n}" for n in range(300))
    text = "## Aufgaben\n\n" + "\n".join(lines) + "\n\n## Anforderungen\n\n" + "\n".join(lines) + f"\n- {words}\n\n## Wir bieten\n\n" + "\n".join(lines)
    row = _structure(spark, {"long": text + "\nLetzte Zeile" * 20_000})["long"]
    assert (len(row["activities"]), len(row["requirements"]), len(row["benefits"])) == (1000, 1001, 1000)
    assert len(row["requirements"][1000]["keywords"]) == 300


def test_first_seen_selection(spark):
    values = ["b", "A", "a", "B", None, "c", "b"] * 3
    frame = spark.createDataFrame([(values,), ([],), (None,)], "v array<string>")
    picked = [r[0] for r in frame.select(T.distinct_by(F.col("v"), F.lower)).collect()]
    assert picked == [["b", "A", "c"], [], None]
    many = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(99_999)), lambda i: (i % 50_000).cast("string")).alias("v"))
    assert many.select(F.size(T.distinct_by(F.col("v"), lambda v: v))).first()[0] == 50_000


def test_continuations_follow_item_chains_only(spark):
    texts = {
        "chain": "- oak\n  ash\n  elm\nbare\n  pine",
        "nested": "- oak\n  - ash\n   elm\n    pine",
        "gap": "- oak\n\n  ash",
    }
    frame = spark.createDataFrame(list(texts.items()), "k string, v string")
    found = dict(frame.select("k", structure.join_continuations(F.col("v"))).collect())
    assert found == {"chain": "- oak ash elm\nbare\n  pine", "nested": "- oak\n  - ash elm\n    pine", "gap": "- oak\n\n  ash"}


def test_seniority_and_role(spark):
    texts = [
        ("years", "Mindestens 7 Jahre Berufserfahrung am Webstuhl.", None),
        ("english", "At least 2 years of experience with looms.", None),
        ("times", "short lead times for every loom", None),
        ("title", "", "Senior Data Engineer"),
        ("context", "Your role: Platform Engineer. You keep looms running.", "Lead Data Analyst"),
        ("late_context", "Wir weben.\n" * 200 + "Your role: Platform Engineer. You keep looms running.", "Lead Data Analyst"),
        ("signals", "\n".join(f"Mindestens {n} Jahre Berufserfahrung" for n in range(1, 9)), None),
    ]
    frame = spark.createDataFrame(texts, "k string, content string, title string").select(
        "k", seniority.seniority(F.col("content")).alias("s"), seniority.job_role(F.col("title"), F.col("content")).alias("role"))
    found = {r["k"]: r for r in frame.collect()}
    years = found["years"]["s"]
    assert (years["level"], years["confidence"], years["years_required"], years["signals"]) == ("professional", 0.92, 7.0, [texts[0][1]])
    assert found["english"]["s"]["years_required"] == 2.0 and found["times"]["s"] is None
    assert found["title"]["role"] == "Data Engineer"
    assert found["context"]["role"] == "Platform Engineer" and found["late_context"]["role"] == "Data Analyst"
    assert len(found["signals"]["s"]["signals"]) == 8 and found["signals"]["s"]["years_required"] == 8.0


def test_quality_gate(spark):
    rows = [
        ("full", "w" * 500, "Weber"),
        ("blocked", "Access denied. Verify you are human.", None),
        ("notice", "Aufgaben: Stoffe weben. Anforderungen: ruhige Hand. Sign in to continue. " + "Der Webstuhl steht am Fenster. " * 30, "Weber"),
        ("challenge", "Verify you are human. " + "Please wait for the check to end. " * 30, "One moment"),
    ]
    frame = spark.createDataFrame(rows, "k string, text string, title string")
    found = {r["k"]: r for r in frame.withColumns(quality.quality_columns(F.col("text"), F.col("title"))).collect()}
    assert {k: r["sufficient"] for k, r in found.items()} == {"full": True, "blocked": False, "notice": True, "challenge": False}
    assert found["full"]["warnings"] == [] and len(found["blocked"]["warnings"]) == 3
    assert found["notice"]["warnings"] == found["challenge"]["warnings"] == ["possible_login_or_bot_protection"]


def test_extracted_text_gate_and_cleanup(spark):
    doubled = "".join(f"{c}{d} " for c, d in zip("Die Weberei am Fluss sucht eine ruhige Hand", "ie Weberei am Fluss sucht eine ruhige Hand ", strict=True))
    rows = [
        ("good", "Weber am Webstuhl " * 40, True),
        ("short", "Weber", False),
        ("marks", "?" * 700, False),
        ("broken", "Stoffe weben und prüfen " * 30 + "�" * 5, False),
        ("columns", "\n".join(f"Spalte {i} kurz" for i in range(50)), False),
        ("doubled", "\n".join(["Weberei", doubled * 2, "Aufgaben und Anforderungen " * 30]), False),
    ]
    frame = spark.createDataFrame(rows, "k string, text string, good boolean")
    assert {r[0]: r[1] for r in frame.select("k", quality.text_is_sufficient(F.col("text"))).collect()} == {k: g for k, _, g in rows}
    text = "Anforderungen\n• Hand-\nArbeit am Web-\nStuhl\n• Geduld\n&nbsp;\nEnde"
    cleaned = spark.createDataFrame([(text,)], "t string").select(quality.normalized_extracted_text(F.col("t"))).first()[0]
    assert cleaned == "Anforderungen\n- Hand-Arbeit am Web-Stuhl\n- Geduld\n\nEnde"
