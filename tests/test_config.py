import pytest

from labelmill.config import check, from_dict, load, override, run_manifest
from labelmill.functions.requests import build_messages, build_request

BASE = {"provider": {"name": "vllm", "base_url": "http://h"}}


def test_defaults():
    j = from_dict(BASE)
    assert (j.provider.timeout, j.workers, j.batch_size, j.repeat, j.directory, j.format) == ("60s", 4, 1, 1, "./output", "json")


@pytest.mark.parametrize("change,message", [
    ({"provider": {}}, "provider name is required"),
    ({"provider": {"name": "other"}}, "unsupported provider"),
    ({"provider": {"name": "vllm"}}, "base_url is required"),
    ({"provider": {"name": "openai"}}, "api_key is required"),
    ({"output": {"format": "xml"}}, "unsupported output format"),
    ({"processing": {"repeat": 11}}, "repeat count"),
])
def test_checks(change, message):
    with pytest.raises(ValueError, match=message):
        from_dict({**BASE, **change})


def test_yaml_environment_and_patterns(tmp_path, monkeypatch, spark):
    monkeypatch.setenv("HOST_X", "http://x")
    p = tmp_path / "job.yaml"
    p.write_text(
        "provider: {name: openai, api_key: '${HOST_X}', base_url: $HOST_X}\nmodel: {name: m, parameters: {temperature: 0.5}}\n"
        "classification:\n  template: {system: s, user: 'u {text}'}\n  parsing: {answer_patterns: ['x (\\d+)$name'], map: {a: b}, thinking_tags: '<t></t>'}\n"
        "processing: {workers: 9, live_metrics: {enabled: true, metric: f1, ground_truth: y}}\noutput: {include_thinking: true}\n"
    )
    j = load(str(p), repeat=3, top_p=0.1)
    assert j.provider.base_url == "http://x" and j.parsing.answer_patterns == [r"x (\d+)$name"] and j.workers == 9
    assert j.repeat == 3 and j.parameters == {"temperature": 0.5, "top_p": 0.1} and j.truth_column == "y" and j.include_thinking
    m = run_manifest(spark, j, note="n").first().settings
    assert m["api_key"] == "[REDACTED]" and m["parameter.top_p"] == "0.1" and "http://x" not in m["api_key"] and m["note"] == "n"


def test_overrides():
    j = override(from_dict(BASE), workers=2, seed=5)
    assert j.workers == 2 and j.parameters["seed"] == 5
    with pytest.raises(ValueError, match="unknown setting"):
        override(j, nonsense=1)
    j.repeat = 0
    with pytest.raises(ValueError):
        check(j)


def test_request_details(spark):
    import json

    from pyspark.sql import functions as F

    body = lambda *a, **k: json.loads(spark.range(1).select(build_request(a[0], build_messages("s", F.lit("u")), *a[1:], **k)).first()[0])
    r = body("vllm", {"seed": 3, "guided_json": {"type": "object", "n": {"a": [1, 2]}}, "stop": []})
    assert r["seed"] == 3 and r["guided_json"] == {"type": "object", "n": {"a": [1, 2]}} and "stop" not in r and "model" not in r
    assert "seed" not in body("vllm", {"seed": 3}, flashinfer_safe=True)
    assert "stream" not in body("openai", {"top_k": 4}, model="m") and "top_k" not in body("openai", {"top_k": 4}, model="m")
    flat = body("llamacpp", {"n": 2, "max_tokens": 5}, features={"stream": True})
    assert flat["prompt"] == "system: s\nuser: u\nassistant: " and flat["n_choices"] == 2 and flat["n_predict"] == 5 and flat["stream"] is False
    with pytest.raises(ValueError):
        body("other")
