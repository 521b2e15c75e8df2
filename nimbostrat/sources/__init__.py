"""Readers, writers and inputs."""
