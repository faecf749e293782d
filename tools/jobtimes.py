"""Per-job wall times from a Spark event log folder (scratch use)."""
import glob
import io
import json
import sys

import zstandard

jobs = {}
for f in sorted(glob.glob(sys.argv[1] + "/*/events*")):
    with open(f, "rb") as fh:
        data = fh.read()
    if f.endswith(".zstd"):
        data = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    for line in data.decode("utf-8", "replace").splitlines():
        try:
            e = json.loads(line)
        except ValueError:
            continue
        if e["Event"] == "SparkListenerJobStart":
            names = [si.get("Stage Name", "") + "/" + str(si.get("Number of Tasks")) for si in e.get("Stage Infos", [])]
            jobs[e["Job ID"]] = [e["Submission Time"], None, " | ".join(names),
                                 len(e.get("Stage IDs", []))]
        elif e["Event"] == "SparkListenerJobEnd":
            jobs[e["Job ID"]][1] = e["Completion Time"]
t0 = min(v[0] for v in jobs.values())
for k, v in sorted(jobs.items()):
    print(k, round((v[0] - t0) / 1000, 2), round(((v[1] or v[0]) - v[0]) / 1000, 2), v[3], v[2][:160])
