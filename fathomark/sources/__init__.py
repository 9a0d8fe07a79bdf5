"""Tables, stores and the plugin registry."""
