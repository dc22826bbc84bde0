"""The named queries: single operators in `queries`, several in one in `composed`, services in `services`, streams and commits in `flows`, what is stored for later reads in `kept`."""

from . import composed, flows, kept, queries, services  # noqa: F401  they register what they define
from .registry import QUERIES, SQL  # noqa: F401
