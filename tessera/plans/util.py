"""Plan helpers live in :mod:`tessera.util`, below operators and plans."""

from tessera.util import *  # noqa: F403
