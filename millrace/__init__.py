"""Millrace: message pipelines and corpus operators expressed as Spark plans."""

from millrace.config import InputSettings, OutputSettings
from millrace.sinks import Sink, build_sink
from millrace.sources import build_source

__all__ = ["InputSettings", "OutputSettings", "Sink", "build_sink", "build_source"]
