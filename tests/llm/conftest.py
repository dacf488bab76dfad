import os

# Small matrices: one thread per process, as on executors.
os.environ.setdefault("OMP_NUM_THREADS", "1")
