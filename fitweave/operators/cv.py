"""CV and portfolio imports: suggestions, entity resolution, conflicts, decisions
(S3, S4, C1-C4, F13, J8, K7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitweave.functions import dates, taxonomy
from fitweave.functions import text as T
from fitweave.operators.ranking import keep_one

CV_SCHEMA = (
    "profile struct<name:string,nationality:string,phone:string,email:string,linkedin:string,github:string,portfolio:string>, "
    "skills struct<categories:array<struct<category:string,skills:array<string>>>,languages:array<struct<language:string,level:string>>>, "
    "work_experience array<struct<company:string,job_title:string,start_date:string,end_date:string,activities:array<string>>>, "
    "education array<struct<institution:string,qualification:string,field:string,date:string>>, "
    "certificates array<struct<name:string,institution:string,date:string>>, "
    "references array<struct<name:string,company:string,job_title:string,linkedin:string>>"
)
# text lists may arrive as JSON arrays or as one string
PORTFOLIO_SCHEMA = (
    "array<struct<name:string,canonical_name:string,title:string,summary:string,description:string,bullets:string,"
    "highlights:string,technologies:string,tech_stack:string,role:string,project_type:string,start_date:string,"
    "end_date:string,source_url:string,url:string,repository_url:string,repository:string>>"
)
_TRANSLATION = "struct<title:string,summary:string,highlights:array<string>>"
TRANSLATED_SCHEMA = (
    f"array<struct<id:string,tags:array<string>,date:string,stack:array<string>,resources:struct<repo:string,live:string>,"
    f"translations:struct<de:{_TRANSLATION},en:{_TRANSLATION}>>>"
)
IGNORED = ["change_reason", "status", "revision", "id", "profile_id"]


def scan_cvs(rows: DataFrame, column: str = "cv_json") -> DataFrame:
    """Parses CV JSON with the declared schema (S3)."""
    return rows.withColumn("cv", F.from_json(column, CV_SCHEMA)).drop(column)


def _text(value: Column) -> Column:
    return T.strip(F.coalesce(value, F.lit("")))


def _filled(value: Column) -> Column:
    return T.blank_to_null(_text(value))


def _list(values: Column) -> Column:
    return F.coalesce(values, F.filter(values, lambda _: F.lit(False)))


def _texts(values: Column) -> Column:
    return F.filter(F.transform(F.coalesce(values, T.empty_words()), lambda v: _text(v)), lambda v: v != "")


def _localization(language: Column, title: Column, **more: Column) -> Column:
    fields = [language.alias("language"), title.alias("title")]
    fields += [value.alias(name) for name, value in more.items()]
    return F.array(F.struct(*fields, F.lit("draft").alias("status")))


def _suggestion(kind: str, data: list[Column], excerpt: Column, keep: Column) -> Column:
    entry = F.struct(
        F.lit(kind).alias("resource_type"), F.to_json(F.struct(*data)).alias("proposed_data"),
        excerpt.alias("source_excerpt"),
    )
    return F.when(keep, entry)


def cv_to_suggestions(cvs: DataFrame, language: str = "de") -> DataFrame:
    """One suggestion per profile fact; incomplete facts are dropped, consent is never given."""
    lang, draft = F.lit(language), F.lit("draft").alias("status")
    cv = F.col("cv")
    p = cv["profile"]
    contact = {
        "full_name": "name", "nationality": "nationality", "phone": "phone", "email": "email",
        "linkedin_url": "linkedin", "github_url": "github", "portfolio_url": "portfolio",
    }
    values = [_filled(p[source]).alias(name) for name, source in contact.items()]
    profile = F.array(
        _suggestion("profile", values, F.lit("Stabile Kontakt- und Profillinks aus dem CV"),
                    F.coalesce(*values).isNotNull())
    )

    def skill_rows(group: Column) -> Column:
        shown = F.coalesce(T.blank_to_null(group["category"]), F.lit("Uncategorized"))
        return F.transform(
            _list(group["skills"]),
            lambda name: _suggestion(
                "skills",
                [_text(name).alias("canonical_name"), taxonomy.skill_category(shown).alias("category"), draft,
                 _localization(lang, _text(name)).alias("localizations")],
                F.concat(shown, F.lit(": "), name), _text(name) != "",
            ),
        )

    skills = F.flatten(F.transform(_list(cv["skills"]["categories"]), skill_rows))
    languages = F.transform(
        _list(cv["skills"]["languages"]),
        lambda i: _suggestion(
            "skills",
            [_text(i["language"]).alias("canonical_name"), F.lit("natural_languages").alias("category"),
             taxonomy.skill_level(i["level"]).alias("proficiency_level"), draft,
             _localization(lang, _text(i["language"])).alias("localizations")],
            T.strip(F.concat(_text(i["language"]), F.lit(": "), F.coalesce(i["level"], F.lit(""))), ": "),
            _text(i["language"]) != "",
        ),
    )
    experiences = F.transform(
        _list(cv["work_experience"]),
        lambda i: _suggestion(
            "experiences",
            [_text(i["company"]).alias("company"), dates.cv_date(i["start_date"]).alias("start_date"),
             dates.cv_date(i["end_date"], end_of_month=True).alias("end_date"), draft,
             _localization(lang, _text(i["job_title"]), bullets=F.coalesce(i["activities"], T.empty_words()))
             .alias("localizations")],
            T.strip(F.concat(_text(i["job_title"]), F.lit(" · "), _text(i["company"]), F.lit(" · "),
                             _text(i["start_date"]), F.lit("–"), _text(i["end_date"])), " ·–"),
            (_text(i["company"]) != "") & (_text(i["job_title"]) != ""),
        ),
    )
    education = F.transform(
        _list(cv["education"]),
        lambda i: _suggestion(
            "education",
            [_text(i["institution"]).alias("institution"),
             dates.cv_date(i["date"], end_of_month=True).alias("end_date"), draft,
             _localization(lang, _text(i["qualification"]), summary=_filled(i["field"])).alias("localizations")],
            T.strip(F.concat_ws(" · ", _text(i["qualification"]), _text(i["institution"]), _text(i["date"])), " ·"),
            (_text(i["institution"]) != "") & (_text(i["qualification"]) != ""),
        ),
    )
    certificates = F.transform(
        _list(cv["certificates"]),
        lambda i: _suggestion(
            "certificates",
            [_text(i["name"]).alias("official_name"), _text(i["institution"]).alias("issuer"),
             dates.cv_date(i["date"]).alias("issued_at"), draft,
             _localization(lang, _text(i["name"])).alias("localizations")],
            T.strip(F.concat_ws(" · ", _text(i["name"]), _text(i["institution"]), _text(i["date"])), " ·"),
            (_text(i["name"]) != "") & (_text(i["institution"]) != ""),
        ),
    )
    references = F.transform(
        _list(cv["references"]),
        lambda i: _suggestion(
            "references",
            [_text(i["name"]).alias("full_name"), T.blank_to_null(i["company"]).alias("organization"),
             F.lit(False).alias("usage_consent"), draft,
             _localization(lang, F.coalesce(_filled(i["job_title"]), _text(i["name"])), summary=_filled(i["linkedin"]))
             .alias("localizations")],
            T.strip(F.concat_ws(" · ", _text(i["name"]), F.coalesce(i["company"], F.lit(""))), " ·"),
            _text(i["name"]) != "",
        ),
    )
    branches = [profile, skills, languages, experiences, education, certificates, references]
    rows = F.concat(*[F.coalesce(b, F.filter(profile, lambda _: F.lit(False))) for b in branches])
    others = [c for c in cvs.columns if c != "cv"]
    return cvs.select(
        *others, F.posexplode(F.filter(rows, lambda s: s.isNotNull())).alias("position", "s")
    ).select(*others, "position", "s.*")


def _json_list(value: Column, separator: str) -> Column:
    """List from a JSON array or from separated text."""
    return _texts(
        F.when(value.startswith("["), F.from_json(value, "array<string>")).otherwise(F.split(value, separator))
    )


def _project_rows(rows: DataFrame, items: Column) -> DataFrame:
    others = [c for c in rows.columns if c != "projects"]
    return rows.select(
        *others, F.posexplode(F.filter(items, lambda s: s.isNotNull())).alias("position", "s")
    ).select(*others, "position", "s.*")


def portfolio_to_suggestions(portfolios: DataFrame, language: str = "de") -> DataFrame:
    """Flat project lists to suggestions; unnamed projects are dropped."""

    def project(i: Column) -> Column:
        def either(*names: str) -> Column:
            return F.coalesce(*[T.blank_to_null(i[n]) for n in names])

        name = _text(either("name", "canonical_name"))
        tech = _json_list(either("technologies", "tech_stack"), ",")
        localization = _localization(
            F.lit(language), _text(F.coalesce(T.blank_to_null(i["title"]), name)),
            summary=_filled(either("summary", "description")),
            bullets=_json_list(either("bullets", "highlights"), "\n"),
        )
        return _suggestion(
            "projects",
            [name.alias("canonical_name"), _filled(i["project_type"]).alias("project_type"), _filled(i["role"]).alias("role"),
             dates.cv_date(i["start_date"]).alias("start_date"),
             dates.cv_date(i["end_date"], end_of_month=True).alias("end_date"),
             _filled(either("source_url", "url")).alias("source_url"),
             _filled(either("repository_url", "repository")).alias("repository_url"),
             tech.alias("technologies"), F.lit("draft").alias("status"), localization.alias("localizations")],
            F.concat_ws(" · ", name, T.blank_to_null(F.array_join(tech, ", "))), name != "",
        )

    parsed = portfolios.withColumn("projects", F.from_json("projects", PORTFOLIO_SCHEMA))
    return _project_rows(parsed, F.transform("projects", project))


def translated_portfolio_to_suggestions(portfolios: DataFrame) -> DataFrame:
    """Project lists with translations to suggestions; untitled projects are dropped."""

    def project(i: Column) -> Column:
        def translation(language: str) -> Column:
            entry = i["translations"][language]
            return F.when(
                _text(entry["title"]) != "",
                F.struct(
                    F.lit(language).alias("language"), _text(entry["title"]).alias("title"),
                    _filled(entry["summary"]).alias("summary"), _texts(entry["highlights"]).alias("bullets"),
                    F.lit("draft").alias("status"),
                ),
            )

        localizations = F.filter(F.array(translation("de"), translation("en")), lambda x: x.isNotNull())
        name, tech = _text(i["id"]), _texts(i["stack"])
        return _suggestion(
            "projects",
            [name.alias("canonical_name"), T.blank_to_null(F.array_join(_texts(i["tags"]), ", ")).alias("project_type"),
             dates.cv_date(i["date"], end_of_month=True).alias("end_date"),
             _filled(i["resources"]["live"]).alias("source_url"), _filled(i["resources"]["repo"]).alias("repository_url"),
             tech.alias("technologies"), F.lit("draft").alias("status"), localizations.alias("localizations")],
            F.concat_ws(" · ", F.get(localizations, F.lit(0))["title"], T.blank_to_null(F.array_join(tech, ", "))),
            (name != "") & (F.size(localizations) > 0),
        )

    parsed = portfolios.withColumn("projects", F.from_json("projects", TRANSLATED_SCHEMA))
    return _project_rows(parsed, F.transform("projects", project))


def identity_key(kind: Column, data: Column) -> Column:
    """Comparable identity of a resource from its JSON; NULL when a part is missing."""

    def field(path: str) -> Column:
        return T.comparable_text(F.get_json_object(data, f"$.{path}"))

    def key(*parts: Column, first_only: bool = False) -> Column:
        present = parts[0] != ""
        if not first_only:
            for part in parts[1:]:
                present = present & (part != "")
        return F.when(present, F.concat_ws("\x1f", *parts))

    title = field("localizations[0].title")
    email = field("email")
    return (
        F.when(kind == "profile", F.lit("profile"))
        .when(kind.isin("skills", "projects"), key(field("canonical_name")))
        .when(kind == "experiences", key(field("company"), title))
        .when(kind == "education", key(field("institution"), title))
        .when(kind == "certificates", key(field("official_name"), field("issuer")))
        .when(
            kind == "references",
            F.when(email != "", F.concat_ws("\x1f", F.lit("email"), email)).otherwise(
                F.when(field("full_name") != "",
                       F.concat_ws("\x1f", F.lit("name"), field("full_name"), field("organization")))
            ),
        )
    )


def match_entities(suggestions: DataFrame, entities: DataFrame) -> DataFrame:
    """Existing entity per suggestion: by given id first, else the oldest with the same key."""
    where = ["profile_id", "resource_type"]
    keyed = entities.withColumn("identity_key", identity_key(F.col("resource_type"), F.col("data")))
    oldest = keep_one(
        keyed.where("identity_key is not null").select(*where, "identity_key", "entity_id", "data", "created_at"),
        [*where, "identity_key"], [F.col("created_at"), F.col("entity_id")],
    ).select(*where, "identity_key", F.col("entity_id").alias("_key_id"), F.col("data").alias("_key_data"))
    by_id = entities.select(
        *where, F.col("entity_id").alias("matched_entity_id"), F.lit(True).alias("_id_hit"), F.col("data").alias("_id_data")
    )
    joined = (
        suggestions.withColumn("identity_key", identity_key(F.col("resource_type"), F.col("proposed_data")))
        .join(by_id, [*where, "matched_entity_id"], "left")
        .join(oldest, [*where, "identity_key"], "left")
    )
    hit = F.coalesce("_id_hit", F.lit(False))
    return joined.withColumn(
        "existing_id", F.when(hit, F.col("matched_entity_id")).otherwise(F.col("_key_id"))
    ).withColumn("existing_data", F.when(hit, F.col("_id_data")).otherwise(F.col("_key_data"))).drop(
        "_id_hit", "_id_data", "_key_id", "_key_data"
    )


# nested values are compared part by part down to this depth, and below it as text with sorted keys
LEVELS = 6
PART = "array<struct<field: string, path: string, token: string, value: variant>>"


def _leaf_token(value: Column, kind: Column) -> Column:
    """A value without parts as comparable text; numbers by value, and true and false as 1 and 0."""
    number = value.try_cast("double")
    return (
        F.when(kind == "STRING", F.concat(F.lit("s:"), T.comparable_text(value.try_cast("string"))))
        .when(kind == "BOOLEAN", F.when(value.try_cast("boolean"), "n:1.0").otherwise("n:0.0"))
        .when(kind == "VOID", "null")
        .when(number.isNotNull() & (F.abs(number) < 9e15), F.concat(F.lit("n:"), (number + 0.0).cast("string")))
        .otherwise(F.concat(F.lit("v:"), F.to_json(value)))
    )


def _kept(entries: Column) -> Column:
    return F.filter(entries, lambda e: ~e["key"].isin(*IGNORED) & ~F.is_variant_null(e["value"]))


def _part(field: Column, path: Column, token: Column, value: Column) -> Column:
    return F.struct(field.alias("field"), path.alias("path"), token.alias("token"), value.alias("value"))


def _opened(parts: Column) -> Column:
    """Each part that is an object or a list in the parts it has; others get their token."""
    nothing = F.lit(None).cast("variant")

    def open_part(p: Column) -> Column:
        value, kind = p["value"], F.schema_of_variant(p["value"])
        fields = _kept(F.map_entries(value.try_cast("map<string,variant>")))
        by_key = F.transform(
            fields, lambda e: _part(p["field"], F.concat(p["path"], F.lit("."), F.to_json(F.array(e["key"]))), F.lit(None).cast("string"), e["value"])
        )
        by_place = F.transform(
            value.try_cast("array<variant>"),
            lambda v, i: _part(p["field"], F.concat(p["path"], F.lit("["), i.cast("string"), F.lit("]")), F.lit(None).cast("string"), v),
        )

        def leaf(token: Column | str) -> Column:
            return F.array(_part(p["field"], p["path"], F.lit(token) if isinstance(token, str) else token, nothing))

        return (
            F.when(p["token"].isNotNull(), F.array(p))
            .when(kind.startswith("OBJECT"), F.when(F.size(fields) > 0, by_key).otherwise(leaf("{}")))
            .when(kind.startswith("ARRAY"), F.when(F.size(by_place) > 0, by_place).otherwise(leaf("[]")))
            .otherwise(leaf(_leaf_token(value, kind)))
        ).cast(PART)

    return F.flatten(F.transform(parts, open_part))


def with_parts(rows: DataFrame, data: str, name: str, levels: int = LEVELS) -> DataFrame:
    """Adds the fields of a JSON object as one flat list of (field, path, token) parts.

    Ignored keys and nulls of objects are left out at every depth, whatever their values; keys have no
    order, and items of lists keep their place.
    """
    fields = _kept(F.map_entries(F.try_parse_json(data).try_cast("map<string,variant>")))
    none = F.lit(None).cast("string")
    rows = rows.withColumn(name, F.transform(fields, lambda e: _part(e["key"], F.lit(""), none, e["value"])).cast(PART))
    opened = _opened(F.col(name))
    for _ in range(levels):
        rows = rows.withColumn(name, opened)
    text = F.transform(name, lambda p: F.struct(p["field"], p["path"], F.coalesce(p["token"], F.concat(F.lit("v:"), F.to_json(p["value"]))).alias("token")))
    return rows.withColumn(name, F.array_sort(text))


def with_conflicts(matched: DataFrame) -> DataFrame:
    """Conflict status and field differences of matched suggestions.

    Both sides become lists of parts; two values are equal if their parts are.  The comparison stays
    inside the row.
    """
    text_map = "map<string,string>"
    both = matched.withColumn("_new", F.from_json("proposed_data", text_map)).withColumn(
        "_old", F.from_json("existing_data", text_map)
    )
    both = with_parts(with_parts(both, "proposed_data", "_new_parts"), "existing_data", "_old_parts")
    rows = F.transform(
        F.filter(F.map_entries("_new"), lambda e: e["value"].isNotNull() & ~e["key"].isin(*IGNORED)),
        lambda e: F.struct(
            e["key"].alias("field"), F.try_element_at(F.col("_old"), e["key"]).alias("existing"),
            e["value"].alias("proposed"),
        ),
    )

    def parts_of(name: str, field: Column) -> Column:
        return F.filter(F.coalesce(name, F.array().cast("array<struct<field: string, path: string, token: string>>")), lambda p: p["field"] == field)

    differing = F.filter(rows, lambda r: parts_of("_new_parts", r["field"]) != parts_of("_old_parts", r["field"]))
    none = F.filter(rows, lambda _: F.lit(False))
    known = F.col("existing_id").isNotNull()
    return (
        both.withColumn("differences", F.when(known, differing).otherwise(none))
        .withColumn(
            "conflict_status",
            F.when(~known, "none").when(F.size("differences") > 0, "conflict").otherwise("duplicate"),
        )
        .drop("_new", "_old", "_new_parts", "_old_parts")
    )


def apply_decisions(matched: DataFrame, decisions: DataFrame) -> DataFrame:
    """Outcome of a batch of review decisions on pending suggestions (C4).

    ``outcome``: create, update, keep, rejected, pending, or a refusal code.
    """
    joined = matched.join(decisions.select("suggestion_id", "decision", "resolution"), "suggestion_id", "left")
    decision, resolution = F.col("decision"), F.coalesce("resolution", F.lit(""))
    known, kind = F.col("existing_id").isNotNull(), F.col("resource_type")
    outcome = (
        F.when(decision.isNull(), "pending")
        .when(F.col("status") != "pending", "cv_suggestion_already_reviewed")
        .when(decision == "reject", "rejected")
        .when(known & (resolution == ""), "cv_conflict_resolution_required")
        .when((resolution == "create_new") & kind.isin("profile", "skills"), "cv_create_new_not_allowed")
        .when((resolution == "keep_existing") & ~known, "cv_matched_entry_not_found")
        .when(resolution == "keep_existing", "keep")
        .when(kind == "profile", "update")
        .when(known & (resolution != "create_new"), "update")
        .otherwise("create")
    )
    return joined.withColumn("outcome", outcome).withColumn(
        "new_status",
        F.when(F.col("outcome").isin("keep", "update", "create"), "applied")
        .when(F.col("outcome") == "rejected", "rejected").otherwise(F.col("status")),
    )


def import_history(batches: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Suggestions with their batch, newest batch first, in long form (K7)."""
    return batches.join(suggestions, "batch_id", "left").orderBy(
        F.desc("batch_created_at"), "batch_id", "created_at", "suggestion_id"
    )
