"""Fixed values and column types of layouts, requests and results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Component flag bits, layout states, patterns, limits.
INIT, STALE, OFFLINE, NOSYNC, EXTENSION = 16, 32, 64, 128, 256
FLR_NONE, FLR_RDONLY, FLR_WRITE_PENDING, FLR_SYNC_PENDING = 0, 1, 2, 3
PATTERN_RAID0, PATTERN_MDT = 0, 2
EOF = 2**63 - 1
MAX_MIRRORS, MAX_OSTS, MAX_OST_INDEX, NAME_MAX, POOL_NAME_MAX = 16, 4096, 65535, 255, 15
MAX_ROUNDS, MAX_STRIPES, MAX_ATTEMPTS = 32, 2000, 100_000
PAGE, COPY_BUFFER, LARGEST_BUFFER, MESSAGE_BYTES, TARGET_TEXT, GOAL_BYTES = 4096, 4 << 20, 64 << 20, 1023, 96, 31
RESULT_SCHEMA, PROGRAM, PROGRAM_VERSION = 2, "tesselake", "1.0"

# Error numbers.
EINTR, EIO, EAGAIN, EBUSY, ENODEV, EINVAL, E2BIG, ENOSPC, ERANGE, ENOLCK, ENOTSUP, ETIMEDOUT, ESTALE = 4, 5, 11, 16, 19, 22, 7, 28, 34, 37, 95, 110, 116
S_IFMT, S_IFREG = 0o170000, 0o100000
TRANSIENT = (EAGAIN, EBUSY, ESTALE, EINTR, ENOLCK, ETIMEDOUT)


@dataclass(frozen=True)
class Flags:
    """Flag masks; other builds of the file system may number them differently."""

    init: int = INIT
    stale: int = STALE
    offline: int = OFFLINE
    nosync: int = NOSYNC
    extension: int = EXTENSION

    @property
    def known(self) -> int:
        return self.init | self.stale | self.offline | self.nosync | self.extension


def _struct(text: str) -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split() for x in text.split(", "))])


COMPONENTS = _struct("file_id long, comp_ord int, mirror_id int, flags long, ext_start long, ext_end long, pattern int, stripe_count int, pool string, has_objects boolean")
OBJECTS = _struct("file_id long, comp_ord int, mirror_id int, stripe_idx int, ost int")
FILES = _struct("file_id long, path string, file_size long, st_dev long, st_ino long, st_nlink int, flr_state int, recorded_goal int, mode string, target_opt int")
