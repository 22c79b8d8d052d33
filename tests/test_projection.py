"""Hand-written documents for every rule of the projection."""

import json

import pytest

from bibliolake.operators.projection import ROOT, build_papers


def document(**parts):
    return json.dumps({ROOT: parts}, ensure_ascii=False)


def head(**fields):
    return {"bibrecord": {"head": fields}}


@pytest.fixture(scope="module")
def project(spark):
    def run(text, **options):
        raw = spark.createDataFrame([(1, 2018, text)], "file_id bigint, year int, raw_json string")
        return build_papers(raw, **options).first()

    return run


def person(given=None, surname=None, preferred=None, **more):
    out = dict(more)
    if given is not None:
        out["ce:given-name"] = given
    if surname is not None:
        out["ce:surname"] = surname
    if preferred:
        out["preferred-name"] = {"ce:given-name": preferred[0], "ce:surname": preferred[1]}
    return out


def subject(name, abbrev=None):
    return {"$": name} | ({"@abbrev": abbrev} if abbrev else {})


def funder(name):
    return {"xocs:funding-agency-matched-string": name}


def test_full_document(project):
    text = document(
        item=head(
            **{
                "citation-title": "A title",
                "abstracts": "Text",
                "source": {
                    "publisher": {"publishername": "Press"},
                    "sourcetitle": "Journal",
                    "publicationdate": {"day": "5", "month": "03", "year": "2018"},
                },
                "citation-info": {"author-keywords": {"author-keyword": [{"$": "k1"}, {"$": "k2"}]}},
            }
        )
        | {"item-info": {"itemidlist": {"ce:doi": "10.1/x"}}}
        | {"coredata": {"dc:creator": {"author": [person("Ann", "Lee"), person("Bo", "Ek")]}}},
        coredata={"citedby-count": "7"},
        authors={"author": [person("Ann", "Lee"), person("Bo", "Ek")]},
        **{"subject-areas": {"subject-area": [subject("Math", "MATH"), subject("Art", "ARTS")]}},
        **{"xocs:funding-list": {"xocs:funding": [funder("F1"), funder("F2")]}},
    )
    row = project(text)
    assert (row.file_id, row.year, row.citation_title, row.abstracts) == (1, 2018, "A title", "Text")
    assert (row.publishername, row.sourcetitle) == ("Press", "Journal")
    assert row.publication_date == "05/03/2018"
    assert row.document_classification_codes == "10.1/x"
    assert row.citedbycount == 7 and row.refcount is None
    assert row.allauthors_name == row.authors_deg_name_json == ["Ann Lee", "Bo Ek"]
    assert [(c.subject, c.abbrev) for c in row.categories] == [("Math", "MATH"), ("Art", "ARTS")]
    assert row.creator == "Ann Lee"
    assert row.keywords == ["k1", "k2"] and row.funding == ["F1", "F2"]
    assert (row.allauthors_count, row.authors_count, row.funding_count) == (2, 2, 2)


def test_single_objects_become_lists(project):
    row = project(
        document(
            authors={"author": person("Ann", "Lee")},
            authkeywords={"author-keyword": {"$": "k"}},
            **{"subject-areas": {"subject-area": subject("Math", "MATH")}},
            coredata={"xocs:funding-list": {"xocs:funding": funder("F")}},
        )
    )
    assert row.allauthors_name == ["Ann Lee"] and row.keywords == ["k"] and row.funding == ["F"]
    assert [c.subject for c in row.categories] == ["Math"]


@pytest.mark.parametrize("value", [None, "plain text", 5])
def test_other_values_give_empty_lists(project, value):
    row = project(document(authors={"author": value}, authkeywords={"author-keyword": value}))
    assert row.allauthors_name == [] and row.keywords == [] and row.categories == [] and row.funding == []
    assert (row.authors_count, row.funding_count, row.creator) == (0, 0, None)


def test_absent_paths(project):
    row = project(document())
    assert row.allauthors_name == [] and row.citation_title is None and row.citedbycount is None


def test_keyword_on_both_paths_counts_twice(project):
    info = {"citation-info": {"author-keywords": {"author-keyword": {"$": "k"}}}}
    row = project(document(item=head(**info), authkeywords={"author-keyword": [{"$": "k"}, {"x": 1}]}))
    assert row.keywords == ["k", "k"]


def test_subjects_are_distinct_and_complete(project):
    row = project(
        document(
            coredata={"subject-areas": {"subject-area": [subject("Math", "MATH"), subject("Math", "MA")]}},
            **{"subject-areas": {"subject-area": [subject("Math", "MATH"), subject("Art")]}},
        )
    )
    assert [(c.subject, c.abbrev) for c in row.categories] == [("Math", "MATH"), ("Math", "MA")]


@pytest.mark.parametrize(
    "day, month, expected", [("1", "Jan", "01/00/2018"), ("9", "12", "09/12/2018"), (None, "12", None)]
)
def test_dates(project, day, month, expected):
    parts = {"month": month, "year": "2018"} | ({"day": day} if day else {})
    assert project(document(item=head(source={"publicationdate": parts}))).publication_date == expected


@pytest.mark.parametrize("value, expected", [("12abc", 12), ("3.9", 3), ("", 0), (7, 7), ("-4", -4)])
def test_citation_counts(project, value, expected):
    assert project(document(coredata={"citedby-count": value})).citedbycount == expected


def test_doi_found_deep_in_document_order(project):
    text = '{"%s":{"z":{"ce:doi":"first"},"a":{"ce:doi":"second"}}}' % ROOT
    assert project(text).document_classification_codes == "first"


def test_first_deep_hit_decides_even_when_null(project):
    text = '{"%s":{"z":{"citedby-count":null},"a":{"citedby-count":"3"}}}' % ROOT
    assert project(text).citedbycount is None
    text = '{"%s":{"z":{"citedby-count": 4 },"a":{"citedby-count":"3"}}}' % ROOT
    assert project(text).citedbycount == 4


def test_key_inside_a_text_value_is_no_hit(project):
    assert project(document(note='see "ce:doi": "x"')).document_classification_codes is None


def test_deep_value_is_unescaped(project):
    assert project(document(deep={"ce:doi": 'a"b\\c/ü'})).document_classification_codes == 'a"b\\c/ü'


def test_author_names(project):
    people = [
        person(preferred=("Pia", "Ray"), given="P", surname="R"),
        person(**{"@auid": "1"}),
        person("  Jo ", "  "),
        person(None, "Solo"),
    ]
    assert project(document(authors={"author": people})).allauthors_name == ["Pia Ray", "Jo", "Solo"]


def test_names_with_degree(project):
    text = document(authors={"author": [person("A", "B", **{"ce:degrees": "Dr"}), person("C", "D")]})
    assert project(text, degree_prefix=True).authors_deg_name_json == ["Dr A B", "C D"]
    assert project(text).authors_deg_name_json == ["A B", "C D"]


def test_creator_degree(project):
    groups = [{"author": [person("X", "Y", **{"@auid": "2", "ce:degrees": "PhD"})]},
              {"author": person("A", "B", **{"@auid": "1", "ce:degrees": "MD"})}]
    text = document(
        item=head(**{"author-group": groups}),
        coredata={"dc:creator": {"author": [person("A", "B", **{"@auid": "1", "ce:degrees": " "})]}},
    )
    assert project(text, with_degree="fallback").creator_degree == "MD"
    assert project(text, with_degree="simple").creator_degree == " "
    assert "creator_degree" not in project(text).asDict()
    with pytest.raises(ValueError):
        project(text, with_degree="other")


def test_creator_skips_blank_names(project):
    text = document(
        item={"coredata": {"dc:creator": {"author": person(" ", "")}}},
        coredata={"dc:creator": {"author": person("A", "B")}},
    )
    assert project(text).creator == "A B"


def test_funders(project):
    text = document(
        **{"xocs:meta": {"xocs:funding-list": {"xocs:funding": funder("Second path")}}},
        coredata={"xocs:funding-list": {"xocs:funding": [funder("  "), funder(""), {"x": 1}, funder("F"), funder("F")]}},
    )
    assert project(text).funding == ["Second path", "F", "F"]


def test_non_ascii_and_escapes_survive(project):
    title = 'Größe "x" \\ 漢字 — é'
    assert project(document(item=head(**{"citation-title": title}))).citation_title == title


def test_object_title_keeps_source_key_order(project):
    row = project(document(item=head(**{"citation-title": {"z": 1, "a": [2]}})))
    assert row.citation_title == '{"z":1,"a":[2]}'


def test_repeated_key_keeps_the_last_value(project):
    text = '{"%s":{"coredata":{"citedby-count":"1","citedby-count":"2"}}}' % ROOT
    assert project(text).citedbycount == 2


def test_projection_is_one_map_stage(spark):
    raw = spark.createDataFrame([(1, 2018, "{}")], "file_id bigint, year int, raw_json string")
    plan = build_papers(raw, with_degree="fallback")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan
    assert plan.count("parseJson") == 1
