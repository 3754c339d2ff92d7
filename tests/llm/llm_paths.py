"""Paths shared by the operator tests."""

SF_SMALL = "/root/testdata/sf0.001"
