"""The change log: batch scans, streaming tail, replay."""
