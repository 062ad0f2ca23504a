"""Streaming: the stateful dedup operator and the two pipelines built from sources, decoding and sinks."""
