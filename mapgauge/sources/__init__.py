"""Readers of manifests, images and driver tables; writers of reports."""
