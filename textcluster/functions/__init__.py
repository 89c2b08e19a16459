"""Scalar column functions (JVM built-ins only)."""

from .text import *  # noqa: F401,F403
from .stopwords import english_stop_words  # noqa: F401
