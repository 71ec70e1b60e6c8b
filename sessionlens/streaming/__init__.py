"""Sessions and funnels of event streams."""
