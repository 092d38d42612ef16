"""Whole licences and notices in many spellings."""

from lexiframe.llm import licences


def scan(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in licences.scan(docs).collect()}


def test_spellings(spark):
    title, mit = licences.TEXTS["MIT"]
    changed = "Copyright (c) 2020 Some One\n\n" + mit.replace("sublicense", "sub-license").upper().replace(" ", "  ")
    got = scan(spark, [mit, f"{title}\n\n{changed}", "Intro.\n\n" + licences.TEXTS["ISC"][1], mit[:-20],
                       "# Licence: none\nReleased under the MIT licence!", ""])
    assert [got[k]["license"] for k in range(6)] == ["MIT", "MIT", None, None, None, None]
    assert [got[k]["licenses"] for k in range(6)] == ["MIT", "MIT", "", "", "MIT", ""]
    assert got[0]["text_digest"] != got[3]["text_digest"] and got[4]["n_matches"] == 1


def test_every_known_text_is_found(spark):
    texts = [(n, t) for n, (title, body) in licences.TEXTS.items() for t in (body, f"{title}\n\n{body}")]
    texts += [(n, t) for n, notices in licences.NOTICES.items() for t in notices]
    got = scan(spark, [t for _, t in texts])
    assert [got[k]["license"] for k in range(len(texts))] == [n for n, _ in texts]
