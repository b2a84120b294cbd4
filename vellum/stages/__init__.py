"""Stages that rewrite documents and style sheets, one resource at a time, under a guard that takes back what it can't prove."""
