"""All registered queries of the library, by inventory id."""

from sweepframe.plans import acceptance, boxes, evaluation, files, live, parity, points, poses, selection, sensors, sweeps, transforms, voxels  # noqa: F401  they register on import
from sweepframe.registry import ORACLE, QUERIES  # noqa: F401
