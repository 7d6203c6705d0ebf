"""Default parameters of the published study; every operator takes them as arguments."""

# fixed values
HOME_BOX = {"west": 11.0273686052, "south": 55.3617373725, "east": 23.9033785336, "north": 69.1062472602}
HOME_TIME_ZONE = "Europe/Stockholm"
RANDOM_MIX = {"d": 42.3, "f": 17.6, "n": 40.1}  # percent
T_MAX = 10800  # seconds of silence that end a stay
