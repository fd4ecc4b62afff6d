from foreledger.functions import scalar
from foreledger.functions.scalar import *  # noqa: F401,F403

__all__ = scalar.__all__
