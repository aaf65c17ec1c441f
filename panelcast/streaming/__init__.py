"""Streaming forms of the pipeline's steps.

The row-level steps (token cleaning, casts, date parsing, median fill with medians fitted in batch, index) need
no state and apply unchanged to a ``readStream`` source (``indexed_stream``). Lead, lag and rolling features
keep state per entity (``panel_feature_stream``).
"""

from panelcast.streaming.panel import panel_feature_stream
from panelcast.streaming.readings import indexed_stream

__all__ = ["indexed_stream", "panel_feature_stream"]
