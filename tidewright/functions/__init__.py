"""Column functions: keys, formulas and calendar parts."""

from .columns import *  # noqa: F401,F403
