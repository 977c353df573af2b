from __future__ import annotations

import pytest

from rolloom import domains
from rolloom.functions.safety import load_filter
from rolloom.operators.scoring import Limits
from rolloom.sources import config as settings
from rolloom.sources import grounding


def test_config(tmp_path, monkeypatch):
    f = tmp_path / "c.yaml"
    f.write_text("domain: {name: qa_from_documents, params: {docs_path: '${WHERE:here}'}}\nchallenger: {provider_model: '${UNSET}'}\nauditor: {provider_model: x/y}\nloop: {max_rounds: 2}\n")
    c = settings.load(f)
    assert c.domain.params == {"docs_path": "here"} and c.challenger.provider_model == "${UNSET}" and c.loop.max_rounds == 2 and c.model("audit").provider_model == "x/y"
    monkeypatch.setenv("WHERE", "there")
    assert settings.load(f).domain.params == {"docs_path": "there"}
    settings.write_snapshot(c, tmp_path / "s.yaml")
    assert settings.load_snapshot(tmp_path / "s.yaml") == c
    (tmp_path / "s.yaml").write_text((tmp_path / "s.yaml").read_text() + "later: 1\n")
    assert settings.load_snapshot(tmp_path / "s.yaml") == c
    with pytest.raises(ValueError, match="later"):
        settings.load(tmp_path / "s.yaml")
    a = Limits()
    assert (a.weak_avg_max, a.weak_max_max, a.strong_avg_min, a.strong_avg_max, a.min_gap, c.dispatcher.concurrency) == (0.65, 0.75, 0.60, 0.95, 0.20, 4)


@pytest.mark.parametrize("bad", [{}, {"domain": {}}, {"domain": {"name": "x"}, "acceptance": {"mode": "odd"}}, {"domain": {"name": "x"}, "loop": {"rounds": 3}}, {"domain": {"name": "x"}, "audit": {"enabled": True}, "auditor": {"provider_model": "a/m"}, "dispatcher": {"mode": "batch"}}])
def test_bad_config(bad):
    with pytest.raises(ValueError):
        settings.build(settings.RunConfig, bad)


def test_domains(tmp_path):
    assert domains.names() == ["math_word_problems", "qa_from_documents"]
    with pytest.raises(KeyError, match="qa_from_documents"):
        domains.build("none")
    (tmp_path / "d.py").write_text("from rolloom.domains.qa import QaFromDocuments\nclass Own(QaFromDocuments):\n    name = 'own'\nx = 1\n")
    assert domains.build(path=f"{tmp_path}/d.py:Own").name == "own"
    with pytest.raises(TypeError):
        domains.build(path=f"{tmp_path}/d.py:x")
    qa, math = domains.build("qa_from_documents"), domains.build("math_word_problems")
    c = {"payload": {"question": "abc", "problem": 5}, "reference_output": " r ", "rubric": []}
    assert len(qa.validate(c)) == 3 and len(math.validate(c | {"reference_output": ""})) == 3
    assert math.verify({"reference_output": "1/2"}, "ANSWER: 3\nAnswer: 0.50") is True and math.verify({"reference_output": "1/2"}, "none") is None and math.verify({"reference_output": "2"}, "ANSWER: x") is None
    assert not qa.verifiable and math.verifiable


def test_filters(tmp_path):
    (tmp_path / "f.py").write_text("def ok(t):\n    return True, []\ndef bad():\n    return 1\nx = 1\n")
    assert load_filter(f"{tmp_path}/f.py:ok")("t") == (True, []) and load_filter(None)("a@b.co")[0] is False
    for spec in (f"{tmp_path}/f.py:bad", f"{tmp_path}/f.py:x"):
        with pytest.raises(TypeError):
            load_filter(spec)
    with pytest.raises(ValueError):
        load_filter("nothing")


def test_grounding(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.md").write_bytes(b"h\xffi " + "é".encode() * 20)
    (tmp_path / "a.TXT").write_text("text")
    (tmp_path / "c.bin").write_text("no")
    rows = grounding.from_files(spark, str(tmp_path), max_chars=8).collect()
    assert [(r.metadata["name"], r.body) for r in rows] == [("a.TXT", "text"), ("b.md", "hi ééééé")]
    topics = grounding.from_topics(spark, [{"topic": "t"}, {"topic": "u", "difficulty": "x"}]).collect()
    from rolloom.operators.transition import stable_id

    assert [r.source_id for r in topics] == [stable_id("math", "t", "?"), stable_id("math", "u", "x")]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nbroken\n[2]\n')
    assert grounding.jsonl(spark, str(tmp_path / "x.jsonl")).count() == 2
