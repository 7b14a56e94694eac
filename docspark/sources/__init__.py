"""Stored collections, snapshots, JSON and binary documents."""
