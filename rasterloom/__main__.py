"""``python -m rasterloom compress|decompress|compare``: single files, without a Spark session."""

from __future__ import annotations

import argparse
import sys
import time

from .errors import RasterError
from .spec import ENCODERS, FILTERS


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rasterloom")
    modes = parser.add_subparsers(dest="mode", required=True)
    c = modes.add_parser("compress", help="portable map to container")
    c.add_argument("input"), c.add_argument("output")
    c.add_argument("-q", "--quality", type=int, default=1024)
    c.add_argument("--block-size", type=int, default=7)
    c.add_argument("--chroma-scale", type=int, default=8)
    c.add_argument("-f", "--filter", choices=list(FILTERS), default="linear")
    c.add_argument("-e", "--encoder", choices=list(ENCODERS), default="turbo")
    c.add_argument("-i", "--intent", choices=["rgb", "rgba", "bgr", "bgra"])
    c.add_argument("-p", "--program", choices=["none", "yuv444", "uyv", "a710_bgr", "a710_rgb"], default="none")
    d = modes.add_parser("decompress", help="container to portable map")
    d.add_argument("input"), d.add_argument("output")
    d.add_argument("-d", "--downsampling", type=int, default=0)
    e = modes.add_parser("compare", help="exit 0 if two maps hold equal samples")
    e.add_argument("input"), e.add_argument("output")
    own = parser.parse_args(args)
    from .sources import images

    try:
        with open(own.input, "rb") as f:
            data = f.read()
        start = time.perf_counter()
        if own.mode == "compare":
            with open(own.output, "rb") as f:
                a, b = images.parse(data), images.parse(f.read())
            same = a.shape == b.shape and (a == b).all()
            print("equal" if same else "different")
            return 0 if same else 1
        if own.mode == "compress":
            made = images.compress(
                data, own.intent, own.program, quality=own.quality, block_size=own.block_size, chroma_scale=own.chroma_scale, filter=own.filter, encoder=own.encoder
            )
        else:
            made = images.decompress(data, own.downsampling)
    except RasterError as problem:
        print(f"{type(problem).__name__}: {problem}", file=sys.stderr)
        return 2
    with open(own.output, "wb") as f:
        f.write(made)
    print(f"{len(data)} bytes to {len(made)} in {(time.perf_counter() - start) * 1e6:.0f} microseconds")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
