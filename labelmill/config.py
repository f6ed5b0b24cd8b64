"""Job settings: a YAML file or a dict, with defaults, checks and overrides."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from labelmill.functions.parsing import ParsingRules
from labelmill.functions.requests import PARAMETER_NAMES

# Accepted names and defaults.
PROVIDERS = ["llamacpp", "vllm", "openai"]
OUTPUT_FORMATS = ["json", "csv", "parquet", "xlsx"]
DEFAULTS = {"timeout": "60s", "workers": 4, "batch_size": 1, "repeat": 1, "directory": "./output", "format": "json"}
MAX_REPEAT = 10


@dataclass
class Provider:
    name: str = ""
    base_url: str = ""
    timeout: str = DEFAULTS["timeout"]
    api_key: str = ""


@dataclass
class LiveMetrics:
    enabled: bool = False
    metric: str = "accuracy"
    ground_truth: str = ""
    average: str = ""
    classes: list[str] = field(default_factory=list)


@dataclass
class Job:
    provider: Provider
    model: str = ""
    parameters: dict = field(default_factory=dict)
    system: str = ""
    user: str = ""
    parsing: ParsingRules = field(default_factory=ParsingRules)
    input_text_field: str = ""
    placeholder_map: dict[str, str] = field(default_factory=dict)
    workers: int = DEFAULTS["workers"]
    batch_size: int = DEFAULTS["batch_size"]
    repeat: int = DEFAULTS["repeat"]
    rate_limit: bool = False
    flashinfer_safe: bool = False
    minimal_mode: bool = False
    live_metrics: LiveMetrics | None = None
    directory: str = DEFAULTS["directory"]
    format: str = DEFAULTS["format"]
    output_text_field: str = ""
    include_raw_response: bool = True
    include_thinking: bool = False
    stream_output: bool = False
    stream_save_every: int = 0
    reference: dict = field(default_factory=dict)

    @property
    def truth_column(self) -> str:
        on = self.live_metrics is not None
        return self.live_metrics.ground_truth if on else ""


def _expand(value: str) -> str:
    """Environment names in provider settings; patterns elsewhere may contain a dollar."""
    return re.sub(r"\$\{(\w+)\}|\$(\w+)", lambda m: os.environ.get(m.group(1) or m.group(2), ""), value)


def from_dict(raw: dict, **overrides) -> Job:
    section = lambda name: raw.get(name) or {}
    provider = {k: _expand(str(v)) for k, v in section("provider").items() if v is not None}
    model, task, run, out = section("model"), section("classification"), section("processing"), section("output")
    mapping = task.get("field_mapping") or {}
    template = task.get("template") or {}
    parsing = {k: v for k, v in (task.get("parsing") or {}).items() if v is not None}
    live = run.get("live_metrics")
    job = Job(
        provider=Provider(**{**{"timeout": DEFAULTS["timeout"]}, **{k: v for k, v in provider.items() if v}}),
        model=model.get("name", ""),
        parameters={k: v for k, v in (model.get("parameters") or {}).items() if v is not None},
        system=template.get("system", ""),
        user=template.get("user", ""),
        parsing=ParsingRules(**parsing),
        input_text_field=mapping.get("input_text_field", ""),
        placeholder_map=mapping.get("placeholder_map") or {},
        live_metrics=LiveMetrics(**live) if live else None,
        output_text_field=out.get("input_text_field", ""),
        reference=section("reference"),
        **{k: run[k] for k in ("workers", "batch_size", "repeat") if run.get(k)},
        **{k: bool(run[k]) for k in ("rate_limit", "flashinfer_safe", "minimal_mode") if k in run},
        **{k: out[k] for k in ("directory", "format") if out.get(k)},
        **{k: out[k] for k in ("include_raw_response", "include_thinking", "stream_output", "stream_save_every") if k in out},
    )
    return check(override(job, **overrides))


def override(job: Job, **values) -> Job:
    """Per-call changes: job fields by name, everything else must be a model parameter."""
    for k, v in values.items():
        if k in Job.__dataclass_fields__:
            setattr(job, k, v)
        elif k in PARAMETER_NAMES:
            job.parameters[k] = v
        else:
            raise ValueError(f"unknown setting: {k}")
    return job


def check(job: Job) -> Job:
    p = job.provider
    problems = [
        (not p.name, "provider name is required"),
        (bool(p.name) and p.name not in PROVIDERS, f"unsupported provider: {p.name}"),
        (p.name != "openai" and not p.base_url, f"base_url is required for provider: {p.name}"),
        (p.name == "openai" and not p.api_key, "api_key is required for OpenAI provider"),
        (job.format not in OUTPUT_FORMATS, f"unsupported output format: {job.format}"),
        (not 1 <= job.repeat <= MAX_REPEAT, f"repeat count must be between 1 and {MAX_REPEAT}"),
    ]
    for bad, message in problems:
        if bad:
            raise ValueError(message)
    return job


def load(path: str, **overrides) -> Job:
    import yaml

    with open(path, encoding="utf-8") as f:
        return from_dict(yaml.safe_load(f) or {}, **overrides)


def run_manifest(spark: SparkSession, job: Job, **extra: str) -> DataFrame:
    """One row of settings to store beside the results; the key is never stored."""
    settings = {
        "provider": job.provider.name, "base_url": job.provider.base_url, "timeout": job.provider.timeout,
        "model": job.model, "workers": job.workers, "batch_size": job.batch_size, "repeat": job.repeat,
        "rate_limit": job.rate_limit, "minimal_mode": job.minimal_mode, "directory": job.directory, "format": job.format,
        "include_raw_response": job.include_raw_response, "include_thinking": job.include_thinking,
        "stream_output": job.stream_output, "stream_save_every": job.stream_save_every,
    }
    settings |= {f"parameter.{k}": v for k, v in job.parameters.items()}
    settings |= extra
    if job.provider.api_key:
        settings["api_key"] = "[REDACTED]"
    return spark.createDataFrame([({k: str(v) for k, v in settings.items()},)], "settings map<string,string>")
