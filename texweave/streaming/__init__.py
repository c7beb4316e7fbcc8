"""The reason-coded filter over an unbounded directory of samples."""
