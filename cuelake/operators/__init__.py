"""DataFrame -> DataFrame operators over caption, packet, sound and session tables."""
