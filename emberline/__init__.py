"""emberline: geolocated sensor-event analytics expressed as Spark DataFrame plans."""
